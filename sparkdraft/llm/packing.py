"""Packing tokenised documents into sequences by first-fit decreasing.

Rows are dealt at random into groups of bounded size, and each group is packed on
its own: its pieces in decreasing length, each into the first sequence that still
has room.  A tournament tree over the sequences' free room finds that sequence
in logarithmic time.  Documents longer than a sequence are cut into full sequences
and a rest.  What room is left in a group is filled by cutting up its emptiest
sequences, so that a group leaves at most one sequence with padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.llm.common import query, text_or_empty, text_workers
from sparkdraft.llm.token_counts import Tokenizer as Cutter
from sparkdraft.llm.token_counts import _words as words_between_spaces

LENGTH = 4096
END_ID = 2
SEED = 42

#: Bytes of text in a group, about; a group's ids fit a task's memory several times.
GROUP_BYTES = 8_000_000
#: Words and marks whose ids a task remembers, twice at most, and bytes of the longest.
REMEMBERED = 100_000
ENTRY_BYTES = 64
#: Rooms below this are left as padding rather than cutting a document for them.
LEAST_CUT = 16


#: Words looked up at a time, about, and texts that go through the tokenizer in one call.
_WORDS = 300_000
_CALL = 4_000

#: Letters of ASCII and Latin-1, each one code point in both cases, and marks that no contraction begins with.
_LETTERS = "a-zÀ-ÖØ-öø-ÿ"
_SPLIT = rf"^(?P<head>[{_LETTERS}]+)(?P<tail>[!-&(-/:-@\[-`{{-~]*)$"


def _table(ids: np.ndarray, stops: np.ndarray) -> pa.LargeBinaryArray:
    """One entry for each of ``stops``: the bytes of ``ids`` from the one before."""
    ends = np.concatenate([[0], stops]).astype("<i8") * ids.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(ends), pa.py_buffer(ids)])


def _ends(column: pa.Array) -> np.ndarray:
    """Where the entries of a column of bytes or text begin, and where the last one ends."""
    if not len(column):
        return np.zeros(1, dtype="<i8")
    return np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, 8 * column.offset)


class WordTokenizer:
    """Ids of whole texts, word by word, where the tokenizer's tokens end with words.

    The words of many texts (runs between the six ASCII white space characters, or what
    :class:`Cutter` says for tokens that hold the space before a word; whole texts where
    nothing is known of the tokenizer) are looked up at once, as Arrow columns.  Where
    the tokenizer lowers case and says which ids end a word, A-Z are lowered first, and
    letters followed by punctuation are put together from the ids of both parts.  Each
    distinct part goes through the tokenizer once as long as it is remembered: those
    used last are.
    """

    def __init__(self, definition: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.remembered = remembered
        self.parts = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        self.used = np.zeros(0, dtype=np.int64)
        self.rounds = 0
        shape = json.loads(definition)
        self.ends = self._word_ends(shape)
        lower = any(n.get("type") == "Lowercase" for n in (shape.get("normalizer") or {}).get("normalizers", []))
        self.cut = Cutter._json_cut(shape)
        self.splits = lower and self.ends is not None and self.cut is words_between_spaces
        self.letters = self._letter_tokenizer(shape) if self.splits else self.tokenizer

    @staticmethod
    def _word_ends(shape: dict) -> np.ndarray | None:
        """For each id, whether it ends a word; None where the vocabulary does not say."""
        suffix = shape["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        vocabulary = shape["model"]["vocab"]
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return ends

    def _letter_tokenizer(self, shape: dict):
        """The same vocabulary without the steps that leave small letters between spaces as they are."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        added = [token["content"] for token in shape.get("added_tokens") or []]
        if any(re.fullmatch(rf"[A-Z{_LETTERS}]+", content) for content in added):
            return self.tokenizer
        tokenizer = Tokenizer(self.tokenizer.model)
        tokenizer.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        return tokenizer

    def _encoded(self, texts: list[str], tokenizer, call: int) -> Iterator[np.ndarray]:
        """The ids of each text; few texts at a time, as what the library returns is far larger than they are."""
        for start in range(0, len(texts), call):
            for encoding in tokenizer.encode_batch_fast(texts[start : start + call], add_special_tokens=False):
                yield np.array(encoding.ids, dtype="<u4")

    def _ids(self, words: pa.Array) -> pa.LargeBinaryArray:
        """Each word through the tokenizer on its own."""
        found = [ids.tobytes() for ids in self._encoded(words.to_pylist(), self.tokenizer, _CALL)]
        return pa.array(found, pa.large_binary())

    def _letter_ids(self, words: pa.Array) -> pa.LargeBinaryArray:
        """The same for words of letters, many in one text: each ends in an id that ends a word."""
        if not len(words):
            return self._ids(words)
        small = pc.utf8_lower(words).to_pylist()
        lines = [" ".join(small[i : i + 200]) for i in range(0, len(small), 200)]
        ids = np.concatenate(list(self._encoded(lines, self.letters, 20)))
        stops = np.flatnonzero(self.ends[ids]) + 1
        return _table(ids, stops) if len(stops) == len(words) else self._ids(words)

    def _part_ids(self, parts: pa.Array) -> pa.LargeBinaryArray:
        """The ids of distinct parts; those not known yet are learnt."""
        self.rounds += 1
        at = pc.index_in(parts, value_set=self.parts)
        fresh = parts.filter(at.is_null())
        self.used[at.drop_null().to_numpy()] = self.rounds
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = pa.repeat(False, len(fresh))
        if self.splits:
            letters = pc.match_substring_regex(fresh, pattern=f"^[{_LETTERS}]+$")
        first = letters.to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(at < 0)
        at[np.concatenate([missing[first], missing[~first]])] = len(self.parts) + np.arange(len(missing))
        new = [fresh.filter(letters), fresh.filter(pc.invert(letters))]
        self.parts = pa.concat_arrays([self.parts, *new])
        self.ids = pa.concat_arrays([self.ids, self._letter_ids(new[0]), self._ids(new[1])])
        self.used = np.concatenate([self.used, np.full(len(fresh), self.rounds)])
        return self.ids.take(pa.array(at))

    def _forget(self) -> None:
        """Keep the parts that were used last, and no long ones, where too much is held."""
        if len(self.parts) <= 2 * self.remembered and self.parts.nbytes <= 2 * self.remembered * ENTRY_BYTES:
            return
        last = np.argsort(-self.used, kind="stable")[: self.remembered]
        kept = np.sort(last[np.diff(_ends(self.parts))[last] <= ENTRY_BYTES])
        self.parts, self.ids, self.used = self.parts.take(kept), self.ids.take(kept), self.used[kept]

    def _ids_of(self, words: pa.Array) -> pa.LargeBinaryArray:
        """The ids of distinct words."""
        if not self.splits:
            return self._part_ids(words)
        head, tail = pc.extract_regex(words, pattern=_SPLIT).flatten()
        parts = pa.concat_arrays([pc.coalesce(head, words), pc.fill_null(tail, "")]).dictionary_encode()
        ids = self._part_ids(parts.dictionary)
        heads, tails = parts.indices[: len(words)], parts.indices[len(words) :]
        return pc.binary_join_element_wise(ids.take(heads), ids.take(tails), pa.scalar(b"", pa.large_binary()))

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(self.cut(text))
            size += len(held[-1])
            if size >= _WORDS:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        words = pa.array(list(chain.from_iterable(texts)), pa.large_string()).dictionary_encode()
        ids = self._ids_of(words.dictionary).take(words.indices)
        self._forget()
        ends = _ends(ids)[np.cumsum([0, *map(len, texts)])].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for start, end in zip(ends, ends[1:]):
            yield data[start:end].tobytes()

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))


@lru_cache(maxsize=1)
def word_tokenizer(definition: str) -> WordTokenizer:
    """One per worker process: what it remembers serves all its tasks."""
    return WordTokenizer(definition)


class TournamentTree:
    """Free room of sequences; each inner node holds the larger of its two children."""

    def __init__(self, length: int):
        self.length = length
        self.size = 1
        self.room = [0, length]
        self.used = 0

    def _grow(self) -> None:
        """Twice the leaves: the old tree becomes the left half."""
        old = self.room[self.size :]
        self.size *= 2
        self.room = [0] * self.size + old + [self.length] * (self.size // 2)
        for i in range(self.size - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first sequence with room: its number and the offset there."""
        if self.room[1] < size:
            self._grow()
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < size:
                i += 1
        leaf = i - self.size
        offset = self.length - room[i]
        room[i] -= size
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        self.used = max(self.used, leaf + 1)
        return leaf, offset


def first_fit_decreasing(sizes: list[int], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; equal sizes keep their order."""
    tree = TournamentTree(length)
    places: list = [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        places[i] = tree.place(sizes[i])
    return [p[0] for p in places], [p[1] for p in places]


def fill_rooms(sizes: list[int], length: int = LENGTH, least: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of ``(piece, start in the piece, length)`` after packing.

    Sequences are taken from the emptiest on, as long as all they hold fits into
    the rooms of the others; their pieces are cut to the rooms, largest room first.
    """
    where, _ = first_fit_decreasing(sizes, length)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(max(where, default=-1) + 1)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held[where[i]].append((i, 0, sizes[i]))
    filled = [sum(n for _, _, n in seq) for seq in held]
    order = sorted(range(len(held)), key=lambda s: (filled[s], s))
    rooms = {s: length - filled[s] for s in order if length - filled[s] >= least}
    total = sum(rooms.values())
    for s in order:
        room = length - filled[s]
        spare = total - (room if s in rooms else 0)
        if filled[s] == length:
            continue
        if filled[s] > spare:
            break
        total -= rooms.pop(s, 0)
        targets = sorted(rooms, key=lambda t: (-rooms[t], t))
        pieces, held[s] = held[s], []
        for piece, start, n in pieces:
            while n:
                t = targets[0]
                cut = min(n, rooms[t])
                held[t].append((piece, start, cut))
                filled[t] += cut
                start, n = start + cut, n - cut
                rooms[t] -= cut
                total -= cut
                if not rooms[t]:
                    del rooms[t]
                    targets.pop(0)
        filled[s] = 0
    return [seq for seq in held if seq]


def tokenised(docs: DataFrame, definition: str, key: str, text: str, length: int, end_id: int, groups: int, seed: int):
    """``grp, row, doc_id, start, length, doc_tokens, ids``: pieces of at most one sequence, dealt to groups."""
    # Keys travel as text: pandas would turn whole numbers with nulls into floats.
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("string").alias("doc_id"),
        text_or_empty(text).alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = word_tokenizer(definition)
        end = np.array([end_id], dtype="<u4").tobytes()

        def flush(out: list) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["grp", "row", "doc_id", "start", "length", "doc_tokens", "ids"])

        for batch in batches:
            out, held = [], 0
            encoded = tokenizer.encode_many(batch["text"].tolist())
            for row, doc_id, ids in zip(batch["row"].tolist(), batch["doc_id"].tolist(), encoded):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    group = zlib.crc32(f"{seed} {row} {start}".encode()) % groups
                    out.append((group, row, doc_id, start, len(piece) // 4, n, piece))
                held += len(ids)
                if held > 8_000_000:
                    yield flush(out)
                    out, held = [], 0
            yield flush(out)

    return rows.mapInPandas(
        run, "grp bigint, row bigint, doc_id string, start bigint, length bigint, doc_tokens bigint, ids binary"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    group_bytes: int = GROUP_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A row's ids are those of its whole text and the end id; a null text is an
    empty one and has the end id alone.  ``ids`` are little-endian unsigned 32-bit
    numbers, ``start`` the row's ids before the piece, ``offset`` the place in its
    sequence, where pieces follow each other without a gap.  Null and repeated keys
    are packed like any others, each row for itself.  Other columns are not looked at.
    """
    text_workers(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text)).cast("bigint"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    pieces = tokenised(docs, definition, key, text, length, end_id, groups, seed)
    kind = docs.schema[key].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "start"], kind="stable").reset_index(drop=True)
        base = int(group["grp"].iloc[0]) << 32
        starts, ids = group["start"].tolist(), group["ids"].tolist()
        place, out = [], []
        for number, sequence in enumerate(fill_rooms(group["length"].tolist(), length)):
            offset = 0
            for piece, start, n in sequence:
                place.append(piece)
                out.append((starts[piece] + start, n, ids[piece][4 * start : 4 * (start + n)], base + number, offset))
                offset += n
        frame = pd.DataFrame(out, columns=["start", "length", "ids", "sequence_id", "offset"])
        for column in ("doc_id", "doc_tokens"):
            frame[column] = group[column].iloc[place].reset_index(drop=True)
        return frame[columns]

    packed = pieces.groupBy("grp").applyInPandas(
        pack, "doc_id string, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))


def default_tokenizer() -> str:
    """The installed public vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_pack_sequences")
def op2(documents: DataFrame) -> DataFrame:
    """The contract's columns of every piece."""
    return pack_documents(documents, default_tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
