"""The rows that the stages of the pipeline store, where scans of one table are split differently."""

from collections import Counter

import pytest

from corpus_pipeline import STAGES
from sparkdraft.llm import mixing as MI
from sparkdraft.llm import simhash as SH

STAGE = dict(STAGES)
SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture()
def docs(spark, documents, tmp_path):
    """The documents in many files, so that the number of partitions follows the setting."""
    documents.repartition(16, "doc_id").write.parquet(f"{tmp_path}/documents")
    return spark.read.parquet(f"{tmp_path}/documents")


def split_anew(spark, stage, docs):
    """The rows of a stage whose result is planned when there are fewer partitions than before."""
    spark.conf.set(SPLITS, "16")
    try:
        many = docs.rdd.getNumPartitions()
        out = stage(spark, docs, "")
        spark.conf.set(SPLITS, "1")
        assert docs.select("*").rdd.getNumPartitions() < many
        return out.collect()
    finally:
        spark.conf.unset(SPLITS)


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\v\f\r")


def test_exact_dedup_keeps_the_right_rows(spark, docs):
    best = {}
    for r in docs.collect():
        best.setdefault(plain(r["text"]), []).append((-len(r["text"] or ""), r["doc_id"], r))
    want = Counter(min(rows, key=lambda x: x[:2])[2] for rows in best.values())
    assert len(want) < docs.count()
    assert Counter(split_anew(spark, STAGE["exact_dedup"], docs)) == want


def test_near_dedup_keeps_the_right_rows(spark, docs):
    rows = docs.collect()
    prints = [SH.fingerprint(r["text"] or "") for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= SH.THRESHOLD:
                up[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    want = Counter(min(group, key=lambda r: r["doc_id"]) for group in groups.values())
    assert len(want) < len(rows)
    assert Counter(split_anew(spark, STAGE["near_dedup"], docs)) == want


def test_mix_holds_the_right_texts(spark, docs):
    texts = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    taken = {r["doc_id"]: r["taken"] for r in MI.mix_sources(docs).collect()}
    found = Counter()
    for r in split_anew(spark, STAGE["mix"], docs):
        words = (r["text"] or "").split()
        assert words == texts[r["doc_id"]][: len(words)]
        found[r["doc_id"]] += len(words)
    assert found == Counter({i: n for i, n in taken.items() if n})


@pytest.mark.parametrize("name", ["exact_dedup", "near_dedup", "mix"])
def test_stages_work_on_rows_that_are_not_read_from_files(spark, docs, name):
    made = docs.select("*").withColumn("n_chars", docs["n_chars"])
    assert Counter(split_anew(spark, STAGE[name], made)) == Counter(split_anew(spark, STAGE[name], docs))
