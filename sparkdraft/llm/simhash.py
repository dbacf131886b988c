"""Near duplicates: SimHash fingerprints compared around anchor points.

The 64 bits have two stretches of 31.  Two fingerprints that differ in at most
three bits differ in at most one bit of one stretch.  In a stretch the anchors
are the 2**26 words of the perfect Hamming code, which cover it with radius one:
every fingerprint has exactly one anchor within one bit, its home.  A partner is
one bit further away, so every fingerprint is sent to all anchors within covering
radius plus threshold, two bits: its home and 15 others, or the home alone where
the stretch is an anchor itself.  Per anchor, the fingerprints at home are
compared with all that were sent there.

Only distinct fingerprints take part, so exact copies cost one row.  Where many
are at home at one anchor, they are dealt out into blocks and the others are sent
to each block.  An anchor reports a spanning forest of its links, never all
pairs; components are found from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.llm.common import numbered, query, stored, text_or_empty, text_workers
from sparkdraft.llm.components import connected_components
from sparkdraft.session import importable

SHINGLE = 3
SEED = 42
THRESHOLD = 3

#: Lowest bit of each stretch, and its length: a Hamming code of length 2**5 - 1.
STRETCHES = (0, 31)
LENGTH = 31

#: Fingerprints at home in one block of an anchor.
BLOCK = 4096
#: Fingerprints compared with a block at a time.
STRIP = 256


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
    else:
        words = [b" ".join(w) for w in zip(*[words[i:] for i in range(shingle)])]
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(w, SEED) for w in words], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    # Whole rows of bits at a time: few enough for counters of one byte.
    for start in range(0, len(hashes), 255):
        part = hashes[start : start + 255]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    chosen = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(chosen.view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed number of the same 64 bits."""

    def run(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return F.pandas_udf(run, "bigint")(text)


def _syndrome(stretch: Column) -> Column:
    """Zero for an anchor, else the place (from 1) of the bit that leads home."""
    places = range(1, LENGTH + 1)
    bits = []
    for k in range(LENGTH.bit_length()):
        mask = sum(1 << (p - 1) for p in places if p >> k & 1)
        parity = F.bit_count(stretch.bitwiseAND(F.lit(mask))).cast("bigint").bitwiseAND(F.lit(1))
        bits.append(F.shiftleft(parity, k))
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def _flips(syndrome: Column) -> Column:
    """The masks that lead from a stretch to the anchors within two bits, home first.

    Two places lead to an anchor when their numbers differ by exactly the syndrome.
    """
    place = F.sequence(F.lit(1).cast("bigint"), F.lit(LENGTH).cast("bigint"))
    one = F.lit(1).cast("bigint")

    def bit(p: Column) -> Column:
        return F.call_function("shiftleft", one, (p - 1).cast("int"))

    pairs = F.transform(
        F.filter(place, lambda p: (p.bitwiseXOR(syndrome) > p) & (p != syndrome)),
        lambda p: bit(p).bitwiseOR(bit(p.bitwiseXOR(syndrome))),
    )
    return F.when(syndrome == 0, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.concat(F.array(bit(syndrome)), pairs)
    )


def anchored(prints: DataFrame) -> DataFrame:
    """``stretch, anchor, away, fp``: each fingerprint at its anchors; ``away`` is 0 at home."""
    parts = [
        prints.select(
            F.lit(i).alias("stretch"),
            F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << LENGTH) - 1)).alias("part"),
            "fp",
        )
        for i, low in enumerate(STRETCHES)
    ]
    both = parts[0].union(parts[1]).select("*", _syndrome(F.col("part")).alias("syndrome"))
    return both.select(
        "stretch", "part", "fp", F.posexplode(_flips(F.col("syndrome"))).alias("away", "mask")
    ).select("stretch", F.col("part").bitwiseXOR(F.col("mask")).alias("anchor"), "away", "fp")


class _Forest:
    """Union by smaller index over the fingerprints at home in one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _forest_links(home: np.ndarray, sent: np.ndarray, forest: _Forest, threshold: int) -> Iterator[tuple]:
    """Links of the fingerprints sent to an anchor, less those that a path replaces."""
    for start in range(0, len(sent), STRIP):
        strip = sent[start : start + STRIP]
        differing = np.bitwise_count(strip[:, None] ^ home[None, :])
        near = (differing <= threshold) & (differing > 0)
        for row in np.flatnonzero(near.any(axis=1)):
            partners = np.flatnonzero(near[row])
            first = int(partners[0])
            yield int(strip[row]), int(home[first])
            for other in partners[1:]:
                if forest.join(first, int(other)):
                    yield int(strip[row]), int(home[other])


def _compare(threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group, those at home first."""
        group, home, forest = None, np.empty(0, np.uint64), None
        for batch in batches:
            found: list[tuple] = []
            keys = batch[["stretch", "anchor", "block"]].to_numpy()
            away = batch["away"].to_numpy()
            prints = batch["fp"].to_numpy().astype(np.int64).view(np.uint64)
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(keys)]
            at_home = np.add.reduceat((away == 0).astype(np.int64), starts)
            # A group inside the batch needs someone at home and a second row.
            worth = (at_home > 0) & (ends - starts > 1)
            worth[[0, -1]] = True
            for start, end, n_home in zip(*(x[worth].tolist() for x in (starts, ends, at_home))):
                key = tuple(keys[start])
                if key != group:
                    group, home, forest = key, np.empty(0, np.uint64), None
                if n_home:
                    home = np.concatenate([home, prints[start : start + n_home]])
                    forest = None
                if end - start > n_home or n_home > 1 or len(home) > n_home:
                    forest = forest or _Forest(len(home))
                    found += _forest_links(home, prints[start:end], forest, threshold)
            if found:
                pairs = np.array(found, dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def near_links(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``fp`` that connect what is to be connected."""
    if threshold != THRESHOLD:
        raise ValueError("two stretches with anchors of radius one serve a threshold of three")
    importable(prints.sparkSession)
    rows = anchored(prints)
    # Anchors with many at home: usually none, and at most a BLOCKth of all fingerprints.
    crowded = stored(
        rows.filter("away = 0")
        .groupBy("stretch", "anchor")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > block)
        .select("stretch", "anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "crowded",
    )
    n = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    dealt = rows.join(crowded, ["stretch", "anchor"], "left").select(
        "stretch",
        "anchor",
        "away",
        "fp",
        F.explode(
            F.when(n == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1))
        ).alias("block"),
        own.alias("own"),
    )
    # At home in its own block, and sent to the others as everyone else.
    seated = dealt.select(
        "stretch",
        "anchor",
        "block",
        F.when((F.col("away") == 0) & (F.col("block") == F.col("own")), 0).otherwise(1).alias("away"),
        "fp",
    )
    grouped = seated.repartition("stretch", "anchor", "block").sortWithinPartitions(
        "stretch", "anchor", "block", "away", "fp"
    )
    return grouped.mapInPandas(_compare(threshold), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, row: Column | None = None
) -> DataFrame:
    """One row per input row: ``row, doc_id, fp, component_id, first_row``.

    ``component_id`` is the smallest id that can be reached over links, the own
    one included (null only where all ids are null); ``first_row`` is the row
    with the smallest id, null ids last.  Rows are numbered by ``row``; without it
    the numbers are of this scan and name no row of another one.  A null text counts as empty; texts without a word have fingerprint
    zero and link like any other.  Other columns are not looked at.
    """
    text_workers(docs.sparkSession)
    rows = stored(
        docs.select(
            (F.monotonically_increasing_id() if row is None else row).alias("row"),
            F.col(key).alias("doc_id"),
            fingerprint_column(text_or_empty(text), shingle).alias("fp"),
        ),
        "prints",
    )
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    prints = stored(rows.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    roots = connected_components(near_links(prints.select("fp")))
    placed = prints.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    firsts = placed.groupBy("root").agg(F.min("first").alias("least"))
    members = stored(
        placed.join(firsts, "root").select(
            "fp", F.col("least.b").alias("component_id"), F.col("least.c").alias("first_row")
        ),
        "members",
    )
    return rows.join(members, "fp").select("row", "doc_id", "fp", "component_id", "first_row")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs``, all columns, with one row of each component: that with the smallest id."""
    rows = numbered(docs, "near-rows")
    found = near_duplicates(rows, f"whole.{key}", f"whole.{text}", shingle, F.col("row"))
    dropped = found.filter("row <> first_row").select("row")
    # The list grows with the corpus: merged at every size, never broadcast.
    return rows.join(stored(dropped, "dropped").hint("merge"), "row", "left_anti").select("whole.*")


@query("op10_simhash_near_dedup")
def op10(documents: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    return near_duplicates(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
