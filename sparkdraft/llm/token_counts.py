"""Token counts of whole texts, looked up in two tiers inside the tasks.

A text is cut into pre-tokens at places where no token of the given tokenizer can
span, so that its count is the sum over its pre-tokens.  Tier one is a table of the
lengths of frequent pre-tokens, which every task gets: one string of words and one
array of lengths, hashed once per worker.  Pre-tokens it lacks go through the
tokenizer, many at a time, and stay in the worker's cache, tier two, while there is
room.  No pre-token is ever shuffled: what is frequent comes from summaries of bounded
size, one per task of a first pass over all texts.  The tables only save work; a count
is the same with any table, or none.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.llm.common import query, text_or_empty
from sparkdraft.session import importable

LIMIT = 2048

#: A task reports the pre-tokens that make up at least this share of what it read, so 1 / SHARE at most.
SHARE = 1e-4
#: Entries of the broadcast table and bytes of one entry, at most.
FREQUENT = 65_536
ENTRY_BYTES = 64
#: Pre-tokens that a worker remembers besides.
REMEMBERED = 200_000
#: Pre-tokens looked up at a time, about.
_WORDS = 300_000
#: Texts that go through the tokenizer in one call.
_CALL = 4_000

#: The pre-tokenizer pattern (fixed value) whose tokens hold no white space, as it keeps matches only.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A single space between printable ASCII characters.
_INNER_SPACE = re.compile(r"(?<=[!-~]) (?=[!-~])")
_BEFORE_INNER_SPACE = re.compile(r"(?<=[!-~])(?= [!-~])")


def _words(text: str) -> list[bytes]:
    """Words between ASCII white space; A-Z are lowered where the tokenizer would do the same."""
    body = text.encode("utf-8")
    # Special tokens are told by case, and a combining mark may join a small letter where it does not join a capital.
    if not (b"<|" in body or b"\xcc" in body or b"\xcd" in body):
        body = body.lower()
    return body.split()


def _spaced(text: str) -> list[bytes]:
    """Words with the space before them."""
    return [w.encode("utf-8") for w in _BEFORE_INNER_SPACE.split(text)]


def _unspaced(text: str) -> list[bytes]:
    """Words without the space before them, which the tokenizer puts there anyway."""
    return [w.encode("utf-8") for w in _INNER_SPACE.split(text)]


def _whole(text: str) -> list[bytes]:
    return [text.encode("utf-8")]


class Tokenizer:
    """Token counts of pre-tokens, and the rule by which texts are cut into them.

    ``definition`` holds the bytes of a ``tokenizers`` file (JSON) or of a ``sentencepiece``
    model.  Where it is not known that tokens end at a space, the text is not cut.
    """

    def __init__(self, definition: bytes, is_json: bool):
        self.cut: Callable[[str], list[bytes]] = _whole
        if is_json:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Library

            self._library = Library.from_str(definition.decode("utf-8"))
            self._library.no_truncation()
            self._library.no_padding()
            self.lengths = self._json_lengths
            self.cut = self._json_cut(json.loads(definition))
        else:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=definition)
            self.lengths = self._piece_lengths
            self.cut = self._piece_cut()

    def _json_lengths(self, words: list[bytes]) -> list[int]:
        found: list[int] = []
        # Few at a time, as what the library returns is far larger than the words.
        for start in range(0, len(words), _CALL):
            texts = [w.decode("utf-8") for w in words[start : start + _CALL]]
            found += (len(e) for e in self._library.encode_batch_fast(texts, add_special_tokens=False))
        return found

    def _piece_lengths(self, words: list[bytes]) -> list[int]:
        found = self._library.encode([w.decode("utf-8") for w in words], num_threads=1)
        return list(map(len, found))

    @staticmethod
    def _json_cut(shape: dict):
        """The rule for the two shapes that are known: kept words, and words with the space before them."""
        for token in shape.get("added_tokens") or []:
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                return _whole
            if re.search(r"\s", token["content"]):
                return _whole
        normalizer, splitter = shape.get("normalizer") or {}, shape.get("pre_tokenizer") or {}
        steps = [n["type"] for n in normalizer.get("normalizers", [])]
        parts = splitter.get("pretokenizers", [])
        if (
            steps == ["NFC", "Replace", "Lowercase"]
            and normalizer["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"] == {"Regex": _WORD_PATTERN}
            and (parts[0]["behavior"], parts[0]["invert"]) == ("Removed", True)
            and not parts[1]["add_prefix_space"]
        ):
            return _words
        if not normalizer and splitter.get("type") == "ByteLevel":
            if splitter.get("use_regex") and not splitter["add_prefix_space"]:
                return _spaced
        return _whole

    def _piece_cut(self):
        """Words, if every word gets a leading space mark and no piece holds one inside."""
        library, mark = self._library, "▁"
        inside = re.compile(f"[^{mark}]{mark}")
        if any(inside.search(library.id_to_piece(i)) for i in range(library.get_piece_size())):
            return _whole
        # One space makes one mark; without a leading mark a word alone would count differently.
        one, two = (library.encode(x, out_type=str) for x in ("a", "a a"))
        return _unspaced if "".join(one) == mark + "a" and "".join(two) == (mark + "a") * 2 else _whole


class Lengths:
    """Both tiers of one worker: the broadcast table, and what was encoded since."""

    def __init__(self, tokenizer: Tokenizer, words: bytes, lengths: bytes, remembered: int = REMEMBERED):
        self.tokenizer = tokenizer
        self.remembered = remembered
        counts = array("H", lengths)
        # Entries end in a zero byte, as pre-tokens may hold line breaks.
        self.frequent = dict(zip(words.split(b"\0"), counts)) if counts else {}
        self.cache: dict[bytes, int] = {}

    def _learn(self, words: set[bytes]) -> dict[bytes, int]:
        """The lengths of the words of one round; only misses of both tiers are encoded."""
        missing = words - self.frequent.keys()
        found = {w: self.cache[w] for w in missing & self.cache.keys()}
        fresh = list(missing - found.keys())
        if fresh:
            new = dict(zip(fresh, self.tokenizer.lengths(fresh)))
            found |= new
            if len(self.cache) + len(new) > self.remembered:
                self.cache = {}
            if len(new) <= self.remembered:
                self.cache |= new
        return found

    def counts(self, texts: list[str]) -> Iterator[int]:
        """The token count of each text."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(self.tokenizer.cut(text))
            size += len(held[-1])
            if size >= _WORDS:
                yield from self._summed(held)
                held, size = [], 0
        yield from self._summed(held)

    def _summed(self, texts: list[list[bytes]]) -> Iterator[int]:
        known = self.frequent | self._learn(set(chain.from_iterable(texts)))
        for words in texts:
            yield sum(map(known.__getitem__, words))


def heavy_words(tokenizer: Tokenizer, batches: Iterator[list[str]], share: float = SHARE) -> list[tuple[bytes, int]]:
    """Pre-tokens that are at least ``share`` of all, with their counts; memory is bounded by ``share`` alone.

    Whenever more than ``8 / share`` are held, those below ``share`` so far are let go.
    """
    seen, total = Counter(), 0
    for texts in batches:
        for text in texts:
            words = tokenizer.cut(text)
            total += len(words)
            for at in range(0, len(words), _WORDS):
                seen.update(words[at : at + _WORDS])
                if len(seen) > 8 / share:
                    seen = Counter({w: n for w, n in seen.items() if n >= share * total})
    fit = ((w, n) for w, n in seen.items() if n >= share * total and len(w) <= ENTRY_BYTES and b"\0" not in w)
    return list(fit)


def frequent_words(texts: DataFrame, definition, is_json: bool, share: float = SHARE, most: int = FREQUENT) -> list[bytes]:
    """The ``most`` most frequent of the pre-tokens that tasks report; ties by bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heavy = heavy_words(_tokenizer(definition, is_json), (b["text"].tolist() for b in batches), share)
        yield pd.DataFrame(heavy, columns=["word", "n"])

    rows = texts.mapInPandas(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in rows.orderBy(F.desc("n"), "word").limit(most).collect()]


#: What this worker process holds: tokenizers and tables by the key of their broadcast.
_HELD: dict = {}


def _tokenizer(definition, is_json: bool) -> Tokenizer:
    return _held(("tokenizer", definition.id), lambda: Tokenizer(definition.value, is_json))


class _Shared:
    """A broadcast value with a key that is the same in all tasks."""

    def __init__(self, spark, value):
        self.id = uuid.uuid4().hex
        self._broadcast = spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._broadcast.value


def _held(key: tuple, make: Callable):
    """One value of each kind: a new key takes the place of the last."""
    kind, name = key
    if _HELD.get(kind, (None,))[0] != name:
        _HELD[kind] = (name, make())
    return _HELD[kind][1]


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    name: str = "n_tokens",
    share: float = SHARE,
    most: int = FREQUENT,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``docs`` with one more column: the tokens of the whole text.

    The counts are those of the library for the file: ``tokenizers`` for ``.json``,
    ``sentencepiece`` for ``.model``, without added tokens, truncation or padding;
    strings of special tokens inside texts are what the library takes them for.  A null
    text is an empty one and has no token.  Repeated rows and rows with null keys are
    counted each, other columns pass through; a column called ``name`` is replaced.
    """
    spark = docs.sparkSession
    importable(spark)
    is_json = tokenizer_path.endswith(".json")
    if not is_json and not tokenizer_path.endswith(".model"):
        raise ValueError(f"neither a .json nor a .model file: {tokenizer_path}")
    with open(tokenizer_path, "rb") as file:
        definition = _Shared(spark, file.read())
    texts = docs.select(text_or_empty(text).alias("text"))
    words = frequent_words(texts, definition, is_json, share, most)
    lengths = Tokenizer(definition.value, is_json).lengths(words) if words else []
    table = [(w, n) for w, n in zip(words, lengths) if n < 2**16]
    # At most ``most`` entries of ENTRY_BYTES and two bytes.
    shared = _Shared(spark, (b"\0".join(w for w, _ in table), array("H", [n for _, n in table]).tobytes()))

    def count(column: pd.Series) -> pd.Series:
        tiers = _held(
            ("lengths", shared.id), lambda: Lengths(_tokenizer(definition, is_json), *shared.value, remembered)
        )
        return pd.Series(list(tiers.counts(column.tolist())), dtype="int64")

    return docs.withColumn(name, F.pandas_udf(count, "bigint")(text_or_empty(text)))


def default_tokenizer() -> str:
    """The installed public vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op12_token_counts")
def op12(documents: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    rows = documents.select("doc_id", text_or_empty().alias("text"))
    return count_tokens(rows, default_tokenizer()).select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
