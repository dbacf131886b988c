"""The prefix trie of conversations: shared beginnings, what hangs below them, what sharing saves.

1. Turns are numbered within their conversation after one sort by ranges, so that a long
   conversation is worked on by as many tasks as it has ranges.  A turn is known by a
   SHA-256 of role and text from here on; texts are read once and never shuffled.
2. A beginning is named by its depth and the exclusive or of 128-bit hashes of
   (place, turn), which needs no pass along the conversation.  Conversations are cut into
   segments of ``SEGMENT`` turns below one such beginning; equal segments become one row with
   its number of conversations before they are sorted.
3. Shards are ranges of segments in lexicographic order.  A task encodes the turns of a shard
   by a dictionary and puts the segments into ternary search trees, median first, so that the
   trees are balanced; one traversal, without recursion, sums members, leaves and savings.
4. Nodes on the path of a shard's first or last segment may go on in the neighbours: these
   boundary nodes are merged by name, and their sums go up along their stored ancestors.
5. What hangs below a segment's end is added by pointer doubling over segment roots: as many
   rounds as the logarithm of the longest conversation's number of segments, none up to ``SEGMENT`` turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkdraft.llm.common import query, stored
from sparkdraft.session import importable

#: Turns per segment, and turns that a task holds as trees at a time.
SEGMENT = 64
SHARD_TURNS = 200_000
#: Ids that are joined to one text before it is hashed.
_IDS = 50_000

NODE = ["depth", "k1", "k2"]
BLOCK = ["seg", "r1", "r2"]


def _xor(name: str) -> Column:
    return F.expr(f"bit_xor({name})")


# --- turns -------------------------------------------------------------------


def ordered_turns(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, pos, digest, bytes``: turns numbered from 0 within each conversation.

    By turn, nulls first, then by the digest of role and text.  Rows without a key
    belong to no conversation and are left out; null roles and texts are empty ones.
    """
    role_text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    size = F.octet_length(role_text[0]).cast("string")
    rows = stored(
        conversations.filter(F.col(f"`{key}`").isNotNull()).select(
            F.col(f"`{key}`").cast("bigint").alias("conv"),
            F.col(f"`{turn}`").alias("turn"),
            F.unhex(F.sha2(F.concat(size, F.lit(":"), *role_text), 256)).alias("digest"),
            F.octet_length(role_text[1]).cast("bigint").alias("bytes"),
        ),
        "turns",
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    # The number of a row in this order holds its partition in the upper bits; stored, it holds for good.
    placed = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv", "digest", "bytes", F.monotonically_increasing_id().alias("at")
        ),
        "ordered-turns",
    ).withColumn("part", F.shiftright("at", 33))
    along = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    starts = starts.select("conv", "part", "first", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    return placed.join(starts, ["conv", "part"]).select(
        "conv", (F.col("before") + F.col("at") - F.col("first")).cast("bigint").alias("pos"), "digest", "bytes"
    )


# --- names of beginnings and segments ----------------------------------------


def _segments(turns: DataFrame, conversations: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct segments, and ``conv, depth, k1, k2``: where each conversation ends."""
    place = F.col("pos")
    words = turns.select(
        "conv",
        "pos",
        F.floor(place / size).cast("int").alias("seg"),
        F.xxhash64("pos", "digest").alias("w1"),
        F.xxhash64("digest", "pos").alias("w2"),
        "bytes",
    )
    # At most ``size`` turns in a list.
    cut = words.groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pos", "w1", "w2", "bytes"))).alias("turns"),
        _xor("w1").alias("x1"),
        _xor("w2").alias("x2"),
    )
    along = Window.partitionBy("conv").orderBy("seg")
    named = stored(
        cut.select(
            "conv",
            "seg",
            F.transform("turns", lambda t: F.struct(t.w1.alias("w1"), t.w2.alias("w2"), t.bytes.alias("bytes"))).alias(
                "turns"
            ),
            _xor("x1").over(along).alias("k1"),
            _xor("x2").over(along).alias("k2"),
            F.expr("k1 ^ x1").alias("r1"),
            F.expr("k2 ^ x2").alias("r2"),
            F.lead("seg").over(along).isNotNull().cast("bigint").alias("more"),
        ),
        "segments",
    )
    last = named.filter("more = 0").select(
        "conv", (F.col("seg") * size + F.size("turns")).cast("bigint").alias("depth"), "k1", "k2"
    )
    turnless = conversations.join(last, "conv", "left_anti").select(
        "conv", *[F.lit(0).cast("bigint").alias(c) for c in NODE]
    )
    distinct = named.groupBy(*BLOCK, "k1", "k2", F.size("turns").alias("length")).agg(
        F.first("turns").alias("turns"),
        F.count("*").alias("n"),
        F.min("conv").alias("conv"),
        F.sum("more").alias("more"),
    )
    return distinct.select(*BLOCK, "turns", "n", "conv", "more"), last.unionByName(turnless)


# --- one shard ---------------------------------------------------------------


class Forest:
    """Ternary search trees over turn codes, one per segment root; every tree node is a trie node.

    A node's links are to the smaller and larger of its siblings and to its first child.
    """

    def __init__(self):
        self.code: list[int] = []
        self.links: list[int] = []  # smaller, equal, larger of node i at 3 * i
        self.parent: list[int] = []

    def node(self, code: int, parent: int) -> int:
        self.code.append(code)
        self.links += (-1, -1, -1)
        self.parent.append(parent)
        return len(self.code) - 1

    def insert(self, root: int, codes: list[int]) -> list[int]:
        """The nodes along ``codes`` below ``root``, made where they are missing."""
        links, known = self.links, self.code
        above, path = root, []
        for code in codes:
            slot = 3 * above + 1
            at = links[slot]
            while at >= 0 and known[at] != code:
                slot = 3 * at + (2 if code > known[at] else 0)
                at = links[slot]
            if at < 0:
                at = self.node(code, above)
                links[slot] = at
            path.append(at)
            above = at
        return path

    def traverse(self, root: int) -> list[int]:
        """All nodes below ``root``, a node before its children, children in the order of their codes."""
        found, stack = [], [(self.links[3 * root + 1], False)]
        while stack:
            at, opened = stack.pop()
            if at < 0:
                continue
            if opened:
                found.append(at)
                stack += ((self.links[3 * at + 2], False), (self.links[3 * at + 1], False))
            else:
                stack += ((at, True), (self.links[3 * at], False))
        return found


def medians(start: int, end: int) -> Iterator[int]:
    """``start`` to ``end - 1``, the middle of every stretch before its halves."""
    stretches = [(start, end)]
    for a, b in stretches:
        if a < b:
            middle = (a + b) // 2
            yield middle
            stretches += ((a, middle), (middle + 1, b))


_KEY = pa.struct([("k1", pa.int64()), ("k2", pa.int64())])
_NODES = pa.schema(
    [(c, pa.int64()) for c in (*NODE, "p1", "p2")]
    + [("seg", pa.int32()), ("r1", pa.int64()), ("r2", pa.int64())]
    + [(c, pa.int64()) for c in ("n", "conv", "parent_conv", "bytes", "n_children", "n_leaves", "saved", "more")]
    + [("boundary", pa.bool_()), ("above", pa.list_(_KEY))]
)
_NODES_DDL = (
    "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, seg int, r1 bigint, r2 bigint, n bigint, conv bigint, "
    "parent_conv bigint, bytes bigint, n_children bigint, n_leaves bigint, saved bigint, more bigint, boundary boolean, "
    "above array<struct<k1: bigint, k2: bigint>>"
)


def _shard_nodes(rows: list[tuple], size: int) -> pa.RecordBatch:
    """The nodes of consecutive segments ``(seg, r1, r2, words, bytes, n, conv, more)``.

    Boundary nodes count only what hangs below them through other nodes than boundary ones.
    """
    codes = {w: i for i, w in enumerate(sorted({w for r in rows for w in r[3]}))}
    spelled = list(codes)
    forest = Forest()
    names: list[tuple[int, int]] = []
    block: list[tuple] = []
    depth: list[int] = []
    bytes_of: list[int] = []
    members: list[int] = []
    least: list = []
    more: list[int] = []
    edge: set[int] = set()
    roots: list[int] = []

    def add(at: int, row: tuple, level: int, size_of: int) -> None:
        """What is known of new node ``at``."""
        if level:
            up, word = names[forest.parent[at]], spelled[forest.code[at]]
            names.append((up[0] ^ word[0], up[1] ^ word[1]))
        else:
            names.append(row[1:3])
        block.append(row[:3])
        depth.append(row[0] * size + level)
        bytes_of.append(size_of)
        members.append(0)
        least.append(None)
        more.append(0)

    start = 0
    while start < len(rows):
        end = start + 1
        while end < len(rows) and rows[end][:3] == rows[start][:3]:
            end += 1
        root = forest.node(-1, -1)
        roots.append(root)
        add(root, rows[start], 0, 0)
        for i in medians(start, end):
            row = rows[i]
            path = forest.insert(root, [codes[w] for w in row[3]])
            for level, at in enumerate(path, 1):
                if at == len(names):
                    add(at, row, level, row[4][level - 1])
            stop = path[-1]
            members[stop] += row[5]
            more[stop] += row[7]
            least[stop] = row[6] if least[stop] is None else min(least[stop], row[6])
            if i in (0, len(rows) - 1):
                edge.update(path)
        start = end
    count = len(names)
    order = [at for root in roots for at in forest.traverse(root)]
    for at in reversed(order):
        up = forest.parent[at]
        members[up] += members[at]
        least[up] = least[at] if least[up] is None else min(least[up], least[at])
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for at in reversed(order):
        if at in edge:
            continue
        leaves[at] += children[at] == 0 and more[at] == 0
        saved[at] += (members[at] - 1) * bytes_of[at]
        up = forest.parent[at]
        children[up] += 1
        leaves[up] += leaves[at]
        saved[up] += saved[at]
    top = set(roots)

    def above(at: int) -> list[dict]:
        found = []
        while (at := forest.parent[at]) not in top:
            found.append({"k1": names[at][0], "k2": names[at][1]})
        return found

    def known_parent(at: int):
        up = forest.parent[at]
        return None if up in top or up in edge else least[up]

    columns = [
        [depth[i] for i in order],
        [names[i][0] for i in order],
        [names[i][1] for i in order],
        [names[forest.parent[i]][0] for i in order],
        [names[forest.parent[i]][1] for i in order],
        [block[i][0] for i in order],
        [block[i][1] for i in order],
        [block[i][2] for i in order],
        [members[i] for i in order],
        [least[i] for i in order],
        [known_parent(i) for i in order],
        [bytes_of[i] for i in order],
        [children[i] for i in order],
        [leaves[i] for i in order],
        [saved[i] for i in order],
        [more[i] for i in order],
        [i in edge for i in order],
        [above(i) if i in edge or more[i] else None for i in order],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODES.types)], schema=_NODES)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    turns = batch.column("turns")
    flat = turns.flatten()
    w1, w2, size = (flat.field(i).to_pylist() for i in range(3))
    bounds = np.concatenate([[0], np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
    words = list(zip(w1, w2))
    others = [batch.column(c).to_pylist() for c in ("seg", "r1", "r2", "n", "conv", "more")]
    for i, (seg, r1, r2, n, conv, more) in enumerate(zip(*others)):
        a, b = bounds[i], bounds[i + 1]
        yield seg, r1, r2, words[a:b], size[a:b], n, conv, more


def _nodes(segments: DataFrame, size: int, shard_turns: int) -> DataFrame:
    """Nodes of all shards; those of ``boundary`` are partial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            for row in _rows(batch):
                held.append(row)
                turns += len(row[3])
                if turns >= shard_turns:
                    yield _shard_nodes(held, size)
                    held, turns = [], 0
        if held:
            yield _shard_nodes(held, size)

    order = [*BLOCK, "turns"]
    sorted_ = segments.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(sorted_.mapInArrow(run, _NODES_DDL), "trie-parts")


def _merged(parts: DataFrame, size: int) -> DataFrame:
    """Whole nodes: boundary parts are summed by name, and their sums go to their ancestors."""
    edge = (
        parts.filter("boundary")
        .groupBy(*NODE)
        .agg(
            *[F.max(c).alias(c) for c in ("p1", "p2", *BLOCK, "bytes")],
            F.sum("n").alias("n"),
            F.min("conv").alias("conv"),
            *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved", "more")],
            F.first("above").alias("above"),
        )
    )
    edge = stored(edge, "trie-boundary")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    # Children of a segment's end come with what hangs there.
    inside = edge.filter((F.col("depth") - 1) != F.col("seg") * size)
    children = inside.groupBy(*up).agg(F.count("*").alias("more_children"))
    owned = (
        edge.join(children, NODE, "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("more_children", F.lit(0)))
        .withColumn("leaf", ((F.col("n_children") == 0) & (F.col("more") == 0)).cast("bigint"))
    )
    # A part's place in ``above`` tells its ancestor's depth.
    lines = owned.select(
        "depth",
        F.posexplode(F.concat(F.array(F.struct("k1", "k2")), "above")).alias("steps", "name"),
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("bytes")).alias("saved"),
    )
    sums = lines.groupBy(
        (F.col("depth") - F.col("steps")).alias("depth"), F.col("name.k1").alias("k1"), F.col("name.k2").alias("k2")
    ).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    columns = [*NODE, "p1", "p2", *BLOCK, "n", "conv", "parent_conv", "n_children", "n_leaves", "saved", "more", "above"]
    whole = owned.drop("n_leaves", "saved").join(sums, NODE).withColumn("parent_conv", F.lit(None).cast("bigint"))
    inner = parts.filter(~F.col("boundary"))
    nodes = inner.select(*columns).unionByName(whole.select(*columns))
    parents = edge.select(*NODE, F.col("conv").alias("parent_conv"))
    known = nodes.filter(F.col("parent_conv").isNotNull())
    # Children of boundary nodes learn their parent's smallest member by its name.
    rest = nodes.filter(F.col("parent_conv").isNull()).drop("parent_conv")
    named = rest.join(
        parents.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv"),
        ["depth", "p1", "p2"],
        "left",
    )
    return stored(known.unionByName(named), "trie-nodes")


def _hanging(nodes: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """Sums of the trie below each segment root, and what they add to nodes above: None without long conversations."""
    roots = stored(
        nodes.filter((F.col("depth") - 1) == F.col("seg") * size)
        .groupBy(*BLOCK)
        .agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")),
        "trie-roots",
    )
    deep = roots.filter("seg > 0")
    if deep.isEmpty():
        return roots, None
    ends = nodes.filter("more > 0").select(
        "depth", "k1", "k2", F.col("seg").alias("up_seg"), F.col("r1").alias("up1"), F.col("r2").alias("up2"), "conv", "above"
    )
    below = stored(
        deep.join(
            ends,
            (ends["depth"] == deep["seg"].cast("bigint") * size) & (ends["k1"] == deep["r1"]) & (ends["k2"] == deep["r2"]),
        ).select(*BLOCK, "up_seg", "up1", "up2", "depth", F.col("conv").alias("root_conv"), "above"),
        "trie-links",
    )
    total = roots.select(*BLOCK, "n_leaves", "saved")
    jump = below.select(*BLOCK, "up_seg", "up1", "up2")
    while not jump.isEmpty():
        # Sums reach 2^i segments up in round i; the links double their reach.
        sent = total.join(jump, BLOCK).groupBy(
            F.col("up_seg").alias("seg"), F.col("up1").alias("r1"), F.col("up2").alias("r2")
        ).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        total = stored(
            total.join(sent, BLOCK, "left").select(
                *BLOCK,
                (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            ),
            "trie-totals",
        )
        onward = jump.select(
            F.col("seg").alias("up_seg"), F.col("r1").alias("up1"), F.col("r2").alias("up2"),
            F.col("up_seg").alias("far_seg"), F.col("up1").alias("far1"), F.col("up2").alias("far2"),
        )
        jump = stored(
            jump.join(onward, ["up_seg", "up1", "up2"]).select(
                *BLOCK, F.col("far_seg").alias("up_seg"), F.col("far1").alias("up1"), F.col("far2").alias("up2")
            ),
            "trie-jumps",
        )
    children = roots.select(*BLOCK, "n_children")
    hung = total.join(below, BLOCK).join(children, BLOCK)
    lines = hung.select(
        "depth",
        F.posexplode(F.concat(F.array(F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2"))), "above")).alias(
            "steps", "name"
        ),
        "n_leaves",
        "saved",
        "n_children",
    )
    none = F.lit(None).cast("bigint")
    added = lines.select(
        (F.col("depth") - F.col("steps")).alias("depth"),
        F.col("name.k1").alias("k1"),
        F.col("name.k2").alias("k2"),
        F.col("n_leaves").alias("add_leaves"),
        F.col("saved").alias("add_saved"),
        F.when(F.col("steps") == 0, F.col("n_children")).otherwise(0).alias("add_children"),
        none.alias("root_conv"),
    )
    tops = nodes.filter((F.col("depth") - 1) == F.col("seg") * size).filter("seg > 0")
    learned = tops.join(below.select(*BLOCK, "root_conv"), BLOCK).select(
        *NODE, *[F.lit(0).cast("bigint").alias(c) for c in ("add_leaves", "add_saved", "add_children")], "root_conv"
    )
    extra = added.unionByName(learned).groupBy(*NODE).agg(
        *[F.sum(c).alias(c) for c in ("add_leaves", "add_saved", "add_children")], F.max("root_conv").alias("root_conv")
    )
    return total.join(children, BLOCK), extra


# --- members that end at a node ----------------------------------------------


def _end_digests(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of every node where a conversation ends.

    SHA-256 of a node's ids needs them one after the other.  Ranges of (node, id) are
    joined to texts of bounded length by as many tasks as there are ranges; one task
    per node then hashes these texts as they come and holds one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NODE], axis=1)
            ids = batch.column("conv").to_pylist()
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist() if len(ids) > 1 else []
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                for i in range(a, b, _IDS):
                    part = ids[i : min(i + _IDS, b)]
                    out.append((*keys[a].tolist(), part[0], ",".join(map(str, part))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*out)] if out else [[]] * 5, names=[*NODE, "first", "ids"]
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, None

        def done(rows: list) -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*NODE, "ends_sha256"])

        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key == node:
                    hashed.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, hashed.hexdigest()))
                node, hashed = key, hashlib.sha256(ids.encode())
            if out:
                yield done(out)
        if node is not None:
            yield done([(*node, hashed.hexdigest())])

    order = [*NODE, "conv"]
    texts = (
        ends.select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(join, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    )
    chained = texts.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return chained.mapInArrow(digest, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


# --- the trie ----------------------------------------------------------------


def build_trie(
    turns: DataFrame, conversations: DataFrame, size: int = SEGMENT, shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """One row per node of the trie of ``turns(conv, pos, digest, bytes)``.

    ``conversations(conv)`` lists all members, those without turns too.  The rows are
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``; without a
    conversation there is no row.
    """
    spark = turns.sparkSession
    importable(spark)
    segments, ends = _segments(turns, conversations, size)
    nodes = _merged(_nodes(segments, size, shard_turns), size)
    roots, extra = _hanging(nodes, size)
    # The trie's root is one row; its smallest member is the parent of all first turns.
    facts = conversations.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    sums = roots.filter("seg = 0").select("n_children", "n_leaves", "saved").collect()
    children, leaves, saved = sums[0] if sums else (0, 1, 0)
    top = spark.createDataFrame(
        [(0, 0, 0, facts["conv"], None, facts["n"], children, leaves, saved)] if facts["n"] else [],
        "depth bigint, k1 bigint, k2 bigint, conv bigint, parent_conv bigint, n bigint, n_children bigint, "
        "n_leaves bigint, saved bigint",
    )
    columns = [*NODE, "conv", "parent_conv", "n", "n_children", "n_leaves", "saved"]
    nodes = nodes.withColumn("parent_conv", F.when(F.col("depth") == 1, F.lit(facts["conv"])).otherwise(F.col("parent_conv")))
    if extra is not None:
        nodes = nodes.join(extra, NODE, "left")
        for c, add in (("n_children", "add_children"), ("n_leaves", "add_leaves"), ("saved", "add_saved")):
            nodes = nodes.withColumn(c, F.col(c) + F.coalesce(add, F.lit(0)))
        nodes = nodes.withColumn("parent_conv", F.coalesce("parent_conv", "root_conv"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.select(*columns)
        .unionByName(top)
        .join(_end_digests(ends), NODE, "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.col("parent_conv").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )


def prefix_trie(
    conversations: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    size: int = SEGMENT,
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """The trie of conversations as they are; see :func:`build_trie` and :func:`ordered_turns`.

    Turns are equal when role and text are; repeated rows are turns of their own and an
    empty text is a turn like any other.  Further columns are not looked at.
    """
    turns = stored(ordered_turns(conversations, key, turn, role, text), "numbered-turns")
    return build_trie(turns, turns.select("conv").distinct(), size, shard_turns)


def branched(turns: DataFrame, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations rebuilt on a common beginning.

    Conversation ``c`` gets the first ``h = crc32(c) % longest`` turns of conversation
    ``c - c % family``, as many as there are, then its own turns after its first ``h``.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % longest).alias("h")
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), head).join(bases, "base", "left")
    plan = stored(
        plan.select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")), "branches"
    )
    beginnings = turns.filter(F.col("pos") < longest - 1).withColumnRenamed("conv", "base")
    heads = beginnings.join(plan, "base").filter("pos < taken").select("conv", "pos", "digest", "bytes")
    # A key per conversation and stretch of turns: a long conversation is joined by many tasks.
    stretch = 4096
    spans = sizes.join(plan, "conv").select(
        "conv", "h", "taken", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / stretch))).alias("span")
    )
    tails = (
        turns.withColumn("span", F.floor(F.col("pos") / stretch))
        .join(spans, ["conv", "span"])
        .filter("pos >= h")
        .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    )
    return heads.unionByName(tails), plan.select("conv")


_SQL = r"""
with recursive turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 as pos, digest, bytes
  from (
    select conv_id, turn, strlen(coalesce(text, '')) as bytes,
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
    from conversations where conv_id is not null
  )
), own as materialized (
  select conv_id, list({'d': digest, 'b': bytes} order by pos) as turns from turns group by 1
), heads as (
  select conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: unicode(x)::bigint)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, y: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end)
  ), 4294967295::bigint) % 9 as h
  from own
), rebuilt as materialized (
  select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as turns
  from heads c left join own b on b.conv_id = c.conv_id - c.conv_id % 5
), beginnings as materialized (
  select conv_id, d as depth, len(turns) = d as ends, list_transform(turns[1:d], lambda t: t.d) as path,
    case when d = 0 then 0 else turns[d].b end as bytes
  from rebuilt, unnest(range(0, len(turns) + 1)) r(d)
), nodes as materialized (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from beginnings group by path, depth
), linked as materialized (
  select n.*, p.conv_id as parent_conv_id, coalesce(k.n_children, 0) as n_children
  from nodes n
  left join nodes p on n.depth = p.depth + 1 and n.path[1:n.depth - 1] = p.path and n.depth > 0
  left join (
    select path[1:depth - 1] as path, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all
  ) k on k.depth = n.depth and k.path = n.path
), sums as (
  select path[1:a] as path, a as depth, count(*) filter (n_children = 0) as n_leaves,
    sum((n_convs - 1) * bytes) as saved_tokens
  from linked, unnest(range(0, depth + 1)) r(a) group by all
)
select l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, s.n_leaves,
  cast(s.saved_tokens as bigint) as saved_tokens, l.ends_sha256
from linked l join sums s using (path, depth)"""


@query("op11_prefix_trie", table="conversations", sql=_SQL)
def op11(conversations: DataFrame) -> DataFrame:
    """The contract's columns of every node of the rebuilt conversations' trie."""
    turns = stored(ordered_turns(conversations), "numbered-turns")
    rebuilt, ids = branched(turns)
    return build_trie(rebuilt, ids)
