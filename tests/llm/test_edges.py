"""Corner cases of earlier operators: repeated rows, line breaks, other tokenizers, untidy markup."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sparkdraft.llm import html_text as HT
from sparkdraft.llm import language as LA
from sparkdraft.llm import packing as PA
from sparkdraft.llm import url_filter as UF
from sparkdraft.llm import warc as WA

# --- language ----------------------------------------------------------------

FRENCH = "le chat est sur la table et il regarde par la fenetre ouverte du salon"
ENGLISH = "the cat sits on the table number {} and looks through the open window"


@pytest.mark.parametrize("same, other", [(FRENCH, ENGLISH), (ENGLISH, FRENCH + " {}")])
def test_repeated_rows_do_not_hide_a_language(spark, same, other):
    rows = [(i, same, "aa") for i in range(3000)] + [(10_000 + i, other.format("x" * (i % 30)), "bb") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = LA.fit(docs)
    assert model.languages == ["aa", "bb"] and set(model.owner.tolist()) == {0, 1}
    assert sum(model.owner == 0) == 1  # one text, one centroid
    found = docs.select("lang", LA.identify(model, docs["text"]).alias("f")).collect()
    assert all(r["f"]["lang_pred"] == r["lang"] and not r["f"]["rejected"] for r in found)


def test_predictions_as_plain_cosines(spark, documents):
    """TF-IDF of hashed n-grams and the nearest centroid, counted with dictionaries."""
    model = LA.fit(documents.filter(LA.may_learn()))
    texts = [r["text"] or "" for r in documents.orderBy("doc_id").limit(80).collect()]
    rows = documents.sparkSession.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r["i"]: r["f"] for r in rows.select("i", LA.identify(model, rows["text"]).alias("f")).collect()}
    shift, mix = 32 - (LA.DIMENSIONS - 1).bit_length(), LA._MIX.tolist()

    def slot(gram, kind):
        return (sum(p * m for p, m in zip(gram, mix)) + (mix[3] if kind == 2 else 0)) % 2**32 >> shift

    for i, text in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        grams = Counter()
        for word in words:
            points = [0, *map(ord, word), 0]
            grams.update(slot((p,), 1) for p in points[1:-1])
            grams.update(slot(points[k : k + 2], 2) for k in range(len(points) - 1))
            grams.update(slot(points[k : k + 3], 3) for k in range(len(points) - 2))
        weights = {g: math.log1p(n) * float(model.idf[g]) for g, n in grams.items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        scores = [sum(w * float(c[g]) for g, w in weights.items()) / norm for c in model.centroids]
        if words:
            assert found[i]["score"] == pytest.approx(max(scores), abs=2e-5)
            assert found[i]["lang_pred"] == model.languages[model.owner[int(np.argmax(scores))]]
        else:
            assert found[i]["lang_pred"] == LA.UNKNOWN


# --- addresses ---------------------------------------------------------------


@pytest.mark.parametrize(
    "url, rule",
    [
        ("http://a.com/x.net\n/foo", None),
        ("http://a.com/net\n/", None),
        ("http://a\nnet/x", None),
        ("http://a\nb.net/x", "net/"),
        ("http://b.net/\nx", "net/"),
        ("http://NET/x", "net/"),
        ("http://xnet/x", None),
        ("http://b.net", None),
        ("http://sub.org/fr/\n", "org/fr/"),
    ],
)
def test_a_path_does_not_pose_as_a_host(spark, url, rule):
    for most in (100_000, 0):
        pages = spark.createDataFrame([(1, url)], "page_id bigint, url string")
        assert UF.judge_urls(pages, UF.BASE_RULES, max_indexed=most).first()["rule"] == rule


def test_rules_without_a_path_fit_all_paths(spark):
    pages = spark.createDataFrame([(1, "http://b.net"), (2, "http://b.net/x"), (3, "http://b.net\nx/y")], "page_id bigint, url string")
    found = UF.judge_urls(pages, [UF.address_rule("net", "block")]).collect()
    assert [r["rule"] for r in sorted(found)] == ["net", "net", None]


# --- archives ----------------------------------------------------------------


def test_keys_of_any_text_come_back(spark, tmp_path):
    keys = ["a\r\nWARC-Type: revisit", "100%", "%0A", "%250D%", "", None, "é\n"]
    pages = spark.createDataFrame([(k, "u", "x" * 200 + str(i % 3)) for i, k in enumerate(keys)], "page_id string, url string, html string")
    archive = WA.write_archive(pages, str(tmp_path / "archive"))
    records = WA.read_records(spark, archive)
    assert Counter(r[0] for r in records.select(WA.key_field("X-Page-ID")).collect()) == Counter(keys)
    told = {r[0] for r in records.select(WA.key_field("X-Refers-To-Page-ID")).collect()}
    assert told <= set(keys)


# --- packing -----------------------------------------------------------------

TEXTS = ["The cat's  house,\n\n(new) 12 J̌ T̈", "", " lead <|endoftext|> x", "é日本 語", "a  b \t c", "word " * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_file_packs_its_own_ids(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {}
    for r in sorted(PA.pack_documents(docs, path, length=256).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    library = Tokenizer.from_file(path)
    for i, text in enumerate(TEXTS):
        want = [*library.encode(text, add_special_tokens=False).ids, PA.END_ID]
        assert np.frombuffer(got[i], "<u4").tolist() == want


def test_unknown_shapes_take_whole_texts(spark):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        shape = json.load(file)
    shape["pre_tokenizer"] = None
    from tokenizers import Tokenizer

    definition = json.dumps(shape)
    library = Tokenizer.from_str(definition)
    for text in ("two words here", "a b  c"):
        assert np.frombuffer(PA.WordTokenizer(definition).encode(text), "<u4").tolist() == library.encode(text).ids


# --- main text ---------------------------------------------------------------

BODY = "The old town lies on the river and it is known for the bridges that were built in it by the people of the valley. "


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<div><p title="a < b">{BODY * 3}</p></div>', (BODY * 3).strip()),
        (f"<div><p><img alt=\"x <b>y</b>\" src='a>b'>{BODY * 3}</p></div>", (BODY * 3).strip()),
        (f'<div><p title="a>{BODY * 3}</p><p class="b">{BODY * 3}</p></div>', "\n".join([(BODY * 3).strip()] * 2)),
        (f"<div><p>{BODY * 3}</p></div><a href=x><div><h3>Next one</h3><p>{BODY * 2}</p></div></a>", (BODY * 3).strip()),
        (f"<article><p>{BODY * 3}</p><a href=x><div><p>{BODY * 2}</p></div></a><p>{BODY}</p></article>", f"{(BODY * 3).strip()}\n{BODY.strip()}"),
        (f"<div><a name=top><p>{BODY * 3}</p><p>{BODY * 3}</p></div>", "\n".join([(BODY * 3).strip()] * 2)),
        (f"<p>{BODY * 2}The sum is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p>", f"{BODY * 2}The sum is x=2 here."),
    ],
)
def test_untidy_markup(html, text):
    assert HT.main_text(html) == text


@pytest.mark.parametrize(
    "sentence",
    [
        "Vanha kaupunki sijaitsee joen rannalla, ja siella asuu paljon ihmisia, jotka rakastavat kirjoja. ",
        "Старый город стоит у широкой реки, где живут люди, которые любят читать толстые книги. ",
    ],
)
def test_pages_in_languages_without_stop_words(sentence):
    html = f"<body><nav>Etusivu</nav><p>{sentence * 3}</p><p>{sentence}</p><div><a href=a>{sentence[:30]}</a> <a href=b>{sentence[:40]}</a></div></body>"
    assert HT.main_text(html) == f"{(sentence * 3).strip()}\n{sentence.strip()}"


def test_quotes_are_read_in_linear_time():
    for html in ('<p title="' * 20_000, "<p a='x" * 20_000, "<a href=x>" * 20_000 + "t" * 100, "<p a=\"b" + "<" * 50_000):
        HT.main_text(html)
