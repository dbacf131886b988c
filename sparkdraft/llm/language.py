"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed character n-grams of its letters, weighted by
TF-IDF and normalised.  Every language has a few centroids, found by clustering
a bounded sample of its labelled texts; the nearest centroid by cosine gives the
language.  A text that is further from it than the labelled texts of like length
is rejected.

Document frequencies and the likeness at each length cover all labelled texts that
may be learned from.  Only the clustering works on a sample, of about :data:`SAMPLE`
texts per language.  Lengths that few labelled texts have are learned from the
beginnings of the sample's texts, longer ones from the longest that are known.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkdraft.functions.rows import evaluate_once
from sparkdraft.llm.common import query, text_or_empty, text_workers

DIMENSIONS = 8192
SAMPLE = 512
CENTROIDS = 4
MAX_LANGUAGES = 1000
UNKNOWN = "und"

#: A text is rejected below this part of the similarity that nearly all labelled texts reach.
FLOOR_PART = 0.5
FLOOR_QUANTILE = 0.01
#: Fewer texts of a length say nothing about that length.
FLOOR_TEXTS = 8
#: Powers of two that lengths are told apart by, and the longest beginning that is looked at.
LENGTHS = 32
LONGEST_START = 12

# Odd multipliers of a multiplicative hash.
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)

_ROUNDS = 12
_STRIP_TEXTS = 64
_STRIP = 1 << 18


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters with one zero between words and before each text, and the text each belongs to."""
    lowered = ["\0" + t.lower() for t in texts]
    sizes = [len(t) for t in lowered]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    points = points * _letters()[points]
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
    keep = (points != 0) | first | np.r_[False, points[:-1] != 0]
    return points[keep], owner[keep]


def count_ngrams(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed 1-, 2- and 3-grams, one row per text, and letters per text.

    N-grams stay in one word; a word's edges count as a letter at either end.
    """
    points, owner = _code_points(texts)
    letters = np.bincount(owner[points != 0], minlength=len(texts))
    counts = np.zeros((len(texts), dimensions), dtype=np.float32)
    shift = np.uint32(32 - (dimensions - 1).bit_length())
    padded = np.concatenate([points, np.zeros(3, np.uint32)])
    for start in range(0, len(points), _STRIP):
        end = min(len(points), start + _STRIP)
        base = int(owner[start])
        rows = int(owner[end - 1]) - base + 1
        # One column more, for what is no n-gram.
        offset = (owner[start:end] - base) * (dimensions + 1)
        a, b, c = padded[start:end], padded[start + 1 : end + 1], padded[start + 2 : end + 2]
        no_a, no_b = a == 0, b == 0
        one = a * _MIX[0]
        two = one + b * _MIX[1]
        slots = []
        for gram, none in ((one, no_a), (two + _MIX[3], no_a & no_b), (two + c * _MIX[2], no_b)):
            slot = (gram >> shift).astype(np.int64)
            slot[none] = dimensions
            slots.append(slot + offset)
        found = np.bincount(np.concatenate(slots), minlength=rows * (dimensions + 1))
        counts[base : base + rows] += found.reshape(rows, dimensions + 1)[:, :dimensions]
    return counts, letters


def _strips(texts: list[str]) -> Iterator[list[str]]:
    """Few texts at a time, fewer where they are long."""
    strip, size = [], 0
    for text in texts:
        if strip and (len(strip) == _STRIP_TEXTS or size + len(text) > _STRIP):
            yield strip
            strip, size = [], 0
        strip.append(text)
        size += len(text)
    if strip:
        yield strip


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norm > 0, norm, 1)


def _length_bin(letters: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(letters, 1))).astype(np.int64)


class LanguageModel(NamedTuple):
    """``floors``: the least similarity by language and length, for every length."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: dict[tuple[int, int], float]


def _document_frequencies(texts: DataFrame, dimensions: int) -> np.ndarray:
    """How many texts have each n-gram slot; the last entry is the number of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(dimensions + 1, dtype=np.int64)
        for batch in batches:
            for strip in _strips(batch["text"].tolist()):
                counts, letters = count_ngrams(strip, dimensions)
                seen[:dimensions] += (counts > 0).sum(axis=0)
                seen[dimensions] += int((letters > 0).sum())
        slots = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": slots, "n": seen[slots]})

    frequencies = np.zeros(dimensions + 1, dtype=np.int64)
    # One row per slot, whatever the corpus.
    totals = texts.select("text").mapInPandas(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    for slot, n in totals.collect():
        frequencies[slot] = n
    return frequencies


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, seeded by the texts furthest from the seeds before."""
    mean = vectors.mean(axis=0)
    seeds = [int(np.argmax(vectors @ mean))]
    nearest = vectors @ vectors[seeds[0]]
    for _ in range(1, min(k, len(vectors))):
        seeds.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[seeds[-1]])
    centroids = vectors[seeds]
    for _ in range(_ROUNDS):
        group = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[group == g].sum(axis=0) if (group == g).any() else centroids[g] for g in range(len(seeds))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centroids


def _likeness(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """``language, whole, size, likeness``: each text by its own language's centroids, and its beginnings where drawn."""
    number = {name: i for i, name in enumerate(model.languages)}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, own, whole = [], [], []
            for text, lang, drawn in zip(batch["text"].tolist(), batch["lang"].tolist(), batch["drawn"].tolist()):
                starts = [text[: 1 << k] for k in range(LONGEST_START) if 1 << k < len(text)] if drawn else []
                parts += [text, *starts]
                own += [number[lang]] * (1 + len(starts))
                whole += [True] + [False] * len(starts)
            at = 0
            for strip in _strips(parts):
                here = slice(at, at + len(strip))
                at += len(strip)
                counts, letters = count_ngrams(strip, len(model.idf))
                mine = np.array(own[here])
                every = _vectors(counts, model.idf) @ model.centroids.T
                likeness = np.where(model.owner[None, :] == mine[:, None], every, -1).max(axis=1).astype(float)
                out = pd.DataFrame({"language": mine, "whole": whole[here], "size": _length_bin(letters), "likeness": likeness})
                # A sample without a letter leaves a language without centroids.
                yield out[(letters > 0) & (likeness >= 0)]

    return texts.select("text", "lang", "drawn").mapInPandas(
        measure, "language bigint, whole boolean, size bigint, likeness double"
    )


def _floors(texts: DataFrame, model: LanguageModel) -> dict[tuple[int, int], float]:
    """The least likeness for every language and length.

    Whole texts say it for their length where there are enough, beginnings where
    there are not, and the nearest length for those without either.  A language
    with too few texts takes the lowest floor that the others have; if no language
    has enough, nothing can be told and nothing is rejected by distance.
    """
    found = (
        _likeness(texts, model)
        .groupBy("language", "whole", "size")
        .agg(F.count("*").alias("n"), F.percentile_approx("likeness", FLOOR_QUANTILE, 10_000).alias("floor"))
        .collect()  # at most two numbers for each language and length
    )
    texts_of, known = Counter(), {}
    for row in sorted(found, key=lambda r: r["whole"]):
        if row["whole"]:
            texts_of[row["language"]] += row["n"]
        if row["n"] >= FLOOR_TEXTS:
            known.setdefault(row["language"], {})[row["size"]] = row["floor"]
    floors = {}
    for language, sizes in known.items():
        if texts_of[language] >= FLOOR_TEXTS:
            for size in range(LENGTHS):
                floors[language, size] = sizes[min(sizes, key=lambda s: (abs(s - size), s))]
    told = {language for language, _ in floors}
    for language in set(range(len(model.languages))) - told if told else ():
        for size in range(LENGTHS):
            floors[language, size] = min(floors[other, size] for other in told)
    return floors


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    sample: int = SAMPLE,
    centroids: int = CENTROIDS,
    dimensions: int = DIMENSIONS,
    max_languages: int = MAX_LANGUAGES,
) -> LanguageModel:
    """Learn from the rows of ``docs`` with a text and a language.

    The sample of a language are its ``sample`` distinct texts of the smallest hash,
    all where there are fewer: repeated rows are drawn as one, and no language is
    without a sample.  More than ``max_languages`` languages are refused.  Without a
    labelled row the model knows no language.
    """
    text_workers(docs.sparkSession)
    labelled = docs.select(text_or_empty(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text <> ''")
    labelled = labelled.withColumn("hash", F.xxhash64(F.lit(1), "text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    # A language's smallest hashes, and the last of them: one row per language.
    ends = (
        labelled.select("lang", "hash")
        .distinct()
        .withColumn("place", place)
        .filter(F.col("place") <= sample)
        .groupBy("lang")
        .agg(F.max("hash").alias("last"))
        .limit(max_languages + 1)
    )
    languages = sorted(ends.collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = [row["lang"] for row in languages]
    frequencies = _document_frequencies(labelled, dimensions)
    n_texts = frequencies[-1]
    idf = (np.log((1 + n_texts) / (1 + frequencies[:-1])) + 1).astype(np.float32)
    drawn = F.coalesce(
        *[F.when(F.col("lang") == row["lang"], F.col("hash") <= row["last"]) for row in languages], F.lit(False)
    )

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), _STRIP_TEXTS):
                part = batch.iloc[start : start + _STRIP_TEXTS]
                counted, letters = count_ngrams(part["text"].tolist(), dimensions)
                rows = _vectors(counted, idf).astype("<f4")
                out = pd.DataFrame({"lang": part["lang"].tolist(), "vector": [r.tobytes() for r in rows]})
                yield out[letters > 0]

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vector", kind="stable")
        rows = np.stack([np.frombuffer(v, "<f4") for v in group["vector"]])
        found = _cluster(rows, centroids).astype("<f4")
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "centroids": [found.tobytes()]})

    learned = (
        labelled.filter(drawn)
        .groupBy("lang", "hash")
        .agg(F.first("text").alias("text"))
        .mapInPandas(vectors, "lang string, vector binary")
        .groupBy("lang")
        .applyInPandas(learn, "lang string, centroids binary")
        .collect()  # a few centroids per language, bounded by max_languages
    )
    owner, matrix = [], []
    for row in sorted(learned, key=lambda r: r["lang"]):
        rows = np.frombuffer(row["centroids"], "<f4").reshape(-1, dimensions)
        number = names.index(row["lang"])
        owner += [number] * len(rows)
        matrix.append(rows)
    all_rows = np.concatenate(matrix) if matrix else np.zeros((0, dimensions), np.float32)
    model = LanguageModel(names, np.array(owner, dtype=np.int64), all_rows, idf, {})
    return model._replace(floors=_floors(labelled.withColumn("drawn", drawn), model)) if matrix else model


_RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def identify(model: LanguageModel, text: Column) -> Column:
    """``lang_pred, score, rejected`` of whole texts.

    A null text and one without a letter are ``und`` with score zero and
    rejected; so is every text where the model knows no language.  Equal scores
    go to the language that sorts first.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores, rejected = [], [], []
        for strip in _strips(texts.fillna("").tolist()):
            counts, letters = count_ngrams(strip, len(model.idf))
            if not len(model.owner):
                letters = np.zeros_like(letters)
                best = np.zeros(len(strip), np.int64)
                score = np.zeros(len(strip))
            else:
                likeness = _vectors(counts, model.idf) @ model.centroids.T
                nearest = np.argmax(likeness, axis=1)
                best = model.owner[nearest]
                score = np.clip(likeness[np.arange(len(strip)), nearest].astype(float), 0, 1)
            for b, s, n, size in zip(best.tolist(), score.tolist(), letters.tolist(), _length_bin(letters).tolist()):
                names.append(model.languages[b] if n else UNKNOWN)
                scores.append(s if n else 0.0)
                rejected.append(n == 0 or s < FLOOR_PART * model.floors.get((b, size), 0.0))
        return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejected})

    return F.pandas_udf(run, _RESULT)(text)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from; rows without an id are not among them, nor learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def may_learn(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 != 2, F.lit(False))


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``, one row per input row; see :func:`identify`."""
    model = fit(docs.filter(may_learn(key)), text, lang, key)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        held_out(key).alias("held_out"),
        identify(model, F.col(text).cast("string")).alias("found"),
    )
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs``, all columns, without the rows that are rejected."""
    model = fit(docs.filter(may_learn(key)), text, lang, key)
    rows = docs.select(F.struct("*").alias("kept_row"), identify(model, F.col(text).cast("string")).alias("found"))
    return evaluate_once(rows).filter(~F.col("found.rejected")).select("kept_row.*")


@query("op5_language_id")
def op5(documents: DataFrame) -> DataFrame:
    """The contract's columns of every document, and whether it is rejected."""
    return identify_languages(documents)
