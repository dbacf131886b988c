"""Nulls, empty and very long texts, repeated rows, empty tables, clashing column names."""

import zlib
from collections import Counter

import pytest

from corpus_pipeline import STAGES, run
from sparkdraft.llm import exact_dedup as ED
from sparkdraft.llm import html_text as HT
from sparkdraft.llm import language as LA
from sparkdraft.llm import license_scan as LS
from sparkdraft.llm import mixing as MI
from sparkdraft.llm import packing as PA
from sparkdraft.llm import quality as QU
from sparkdraft.llm import simhash as SH
from sparkdraft.llm import url_filter as UF
from sparkdraft.llm import warc as WA
from sparkdraft.llm.common import new_folder


LONG_PAGE = "<article><p>" + "The text of it. " * 20 + "</p></article>"


def archived(pages):
    return WA.read_records(pages.sparkSession, WA.write_archive(pages, new_folder(pages.sparkSession, "t")))


DOC_OPERATORS = {
    "quality": QU.quality_rules,
    "exact": ED.exact_dedup,
    "simhash": SH.near_duplicates,
    "mix": MI.mix_sources,
    "language": LA.identify_languages,
    "license": LS.scan_licenses,
    "pack": lambda d: PA.pack_documents(d, PA.default_tokenizer()),
}
PAGE_OPERATORS = {
    "url": lambda p: UF.judge_urls(p, (*UF.BASE_RULES, *UF.WORD_RULES)),
    "url_join": lambda p: UF.judge_urls(p, (*UF.BASE_RULES, *UF.WORD_RULES), max_indexed=0),
    "warc": archived,
    "html": HT.extract_main_text,
}


@pytest.mark.parametrize("name", list(DOC_OPERATORS))
def test_empty_documents(odd_documents, name):
    assert DOC_OPERATORS[name](odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(PAGE_OPERATORS))
def test_empty_pages(odd_pages, name):
    assert PAGE_OPERATORS[name](odd_pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in DOC_OPERATORS if n != "pack"])
def test_one_row_for_each_document(odd_documents, name):
    rows = DOC_OPERATORS[name](odd_documents).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_documents.collect())


@pytest.mark.parametrize("name", [n for n in PAGE_OPERATORS if n != "warc"])
def test_one_row_for_each_page(odd_pages, name):
    rows = PAGE_OPERATORS[name](odd_pages).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(r["page_id"] for r in odd_pages.collect())


def test_quality_of_nothing(odd_documents):
    rows = {r["doc_id"]: r for r in QU.quality_rules(odd_documents).collect()}
    for i in (3, 4, 5):
        assert (rows[i]["n_words"], rows[i]["word_chars"], rows[i]["base_failed"], rows[i]["kept"]) == (0, 0, True, False)
    assert rows[7]["n_words"] == 90_000


def test_exact_copies(odd_documents):
    rows = ED.exact_dedup(odd_documents).collect()
    cats = [r for r in rows if r["keep_id"] == 2]
    # The longest original is document 2; of rows 1, 1 and null none stays.
    assert len(cats) == 4 and {r["group_size"] for r in cats} == {4}
    assert [r["doc_id"] for r in cats if r["kept"]] == [2]
    empty = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert {r["keep_id"] for r in empty} == {5} and {r["group_size"] for r in empty} == {4}
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})


def test_repeated_rows_leave_one(odd_documents):
    twice = odd_documents.filter("doc_id = 1")
    assert sum(r["kept"] for r in ED.exact_dedup(twice).collect()) == 1
    assert ED.drop_copies(twice).count() == 1
    assert SH.drop_near_copies(twice).count() == 1


def test_buckets_split_alike(documents):
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    whole = ED.exact_dedup(documents).select(*columns).collect()
    split = ED.exact_dedup(documents, bucket_rows=3, level_bits=2).select(*columns).collect()
    assert sorted(whole) == sorted(split)


def test_directory_doubles_where_it_is_full(spark):
    leaves = [0] * 5 + [1] * 5 + [2] + [7] * 9
    df = spark.createDataFrame([(i - 8 if i > 3 else i,) for i in leaves], "leaf bigint")
    keys = df.selectExpr("shiftleft(leaf, 61) as hash")
    rows = ED.directory(keys, bucket_rows=6, level_bits=3).collect()
    found = {r["leaf"]: (r["depth"], r["bucket"] % 2**64 >> 64 - r["depth"], r["held"]) for r in rows}
    # 11 below prefix 0 and 10 below 00 are too many, one below 01 is not; 9 at the last bit stay together.
    assert found == {0: (3, 0, 5), 1: (3, 1, 5), 2: (2, 1, 1), 3: (2, 1, 1), 7: (3, 7, 9)}


def test_buckets_split_until_they_fit(spark):
    keys = spark.range(400).selectExpr("shiftright(xxhash64(id), 20) as hash").union(
        spark.range(9).selectExpr("cast(77 as bigint) as hash")
    )
    rows = ED.with_buckets(keys, bucket_rows=4, level_bits=5).collect()
    assert len(rows) == 409
    held = Counter((r["depth"], r["bucket"]) for r in rows)
    assert max(d for d, _ in held) == 60 and max(n for (d, _), n in held.items() if d < 60) <= 4
    for r in rows:
        assert (r["hash"] % 2**64) >> (64 - r["depth"]) == (r["bucket"] % 2**64) >> (64 - r["depth"])


def test_links_of_a_chain(documents):
    _, index = ED.build_index(documents.union(documents.limit(3)), bucket_rows=5, level_bits=3)
    rows = index.collect()
    assert {r["link"] for r in rows} == {1} and len({r["bucket"] for r in rows}) > 3
    assert sum(r["group_size"] for r in rows) == documents.count() + 3


def test_simhash_of_nothing(odd_documents):
    rows = [r for r in SH.near_duplicates(odd_documents).collect() if r["fp"] == 0]
    assert {r["doc_id"] for r in rows} == {3, 4, 5, None} and {r["component_id"] for r in rows} == {3}


def test_mix_takes_targets(odd_documents):
    rows = MI.mix_sources(odd_documents).collect()
    sources = {}
    for r in rows:
        key = (r["source_size"], r["target"])
        sources[key] = sources.get(key, 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for (size, target), taken in sources.items():
        assert abs(taken - target) <= 1 and target <= 2 * size


def test_pack_keeps_every_id(odd_documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PA.default_tokenizer())
    want = Counter()
    for r in odd_documents.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[(r["doc_id"], tuple(ids))] += 1
    pieces = PA.pack_documents(odd_documents.filter("doc_id <> 1 and doc_id is not null"), PA.default_tokenizer()).collect()
    docs, sequences = {}, {}
    for p in pieces:
        ids = [int.from_bytes(p["ids"][i : i + 4], "little") for i in range(0, len(p["ids"]), 4)]
        assert len(ids) == p["length"] > 0
        docs.setdefault(p["doc_id"], []).append((p["start"], ids))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for doc_id, parts in docs.items():
        joined = [i for _, ids in sorted(parts) for i in ids]
        assert want[(doc_id, tuple(joined))] == 1
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= PA.LENGTH


def test_language_without_letters(odd_documents):
    rows = {r["doc_id"]: r for r in LA.identify_languages(odd_documents).collect()}
    for i in (3, 4, 5, 6):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["rejected"]) == ("und", 0.0, True)
    assert not rows[8]["rejected"] and 0 < rows[8]["score"] <= 1
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())


def test_no_labels_know_no_language(odd_documents):
    rows = LA.identify_languages(odd_documents.filter("doc_id = 6")).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]


def test_archive_of_odd_pages(odd_pages):
    rows = archived(odd_pages).select(
        WA.header_field("X-Page-ID").alias("page"),
        WA.header_field("WARC-Type").alias("kind"),
        WA.header_field("X-Refers-To-Page-ID").alias("first"),
        "payload",
        "payload_bytes",
    ).collect()
    assert len(rows) == odd_pages.count()
    # The long page is there four times: 1 is the response, 2, 2 and null visit it again.
    long = [r for r in rows if r["payload_bytes"] == len(LONG_PAGE)]
    assert sorted((r["page"] or "", r["kind"], r["first"] or "") for r in long) == [
        ("", "revisit", "1"), ("1", "response", ""), ("2", "revisit", "1"), ("2", "revisit", "1"),
    ]
    assert all(r["kind"] == "response" for r in rows if r["payload_bytes"] < 100)
    want = Counter((r["html"] or "").encode() for r in odd_pages.collect())
    assert Counter(bytes(r["payload"]) for r in rows) == want


def test_archive_writes_whole_records(odd_pages):
    for r in WA.record_bytes(archived(odd_pages)).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert len(rest) == size + 4


def test_addresses(odd_pages):
    rows = {r["page_id"]: r for r in UF.judge_urls(odd_pages.filter("page_id is not null"), (*UF.BASE_RULES, *UF.WORD_RULES)).collect()}
    assert tuple(rows[1])[1:] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert tuple(rows[3])[1:] == ("", "", None, "allow") and tuple(rows[4])[1:] == ("", "", None, "allow")
    assert tuple(rows[5])[1:] == ("example.com", "", None, "allow")
    assert tuple(rows[6])[1:] == ("sub.org", "/fr/POKER", "org/fr/", "allow")


@pytest.mark.parametrize("name,stage", STAGES[:-1])
def test_stage_keeps_columns(spark, odd_documents, name, stage):
    out = stage(spark, odd_documents, "")
    assert out.columns == odd_documents.columns and out.dtypes == odd_documents.dtypes
    out.collect()
    assert stage(spark, odd_documents.limit(0), "").count() == 0


def test_pipeline_of_odd_documents(spark, odd_documents, tmp_path):
    odd_documents.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = run(spark, str(tmp_path)).collect()
    assert pieces and all(p["length"] > 0 for p in pieces)
    odd_documents.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert run(spark, f"{tmp_path}/none").count() == 0


def test_batches_of_texts_leave_the_session_its_own(spark):
    from sparkdraft.llm.common import TEXT_BATCH, text_workers

    rows, size = TEXT_BATCH
    before = {key: spark.conf.getAll.get(key) for key in TEXT_BATCH}
    try:
        spark.conf.set(rows, "7")
        spark.conf.unset(size)
        text_workers(spark)
        assert spark.conf.get(rows) == "7" and spark.conf.get(size) == TEXT_BATCH[size]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
