"""Operators that SQL cannot express, against brute force on whole small tables."""

import random
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash

from sparkdraft.llm import components as CO
from sparkdraft.llm import html_text as HT
from sparkdraft.llm import language as LA
from sparkdraft.llm import license_scan as LS
from sparkdraft.llm import mixing as MI
from sparkdraft.llm import packing as PA
from sparkdraft.llm import simhash as SH
from sparkdraft.llm import url_filter as UF
from sparkdraft.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def classes(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def rows_of(spark, name, folder=SF):
    return QUERIES[name].run(spark, folder).collect()


# --- SimHash -----------------------------------------------------------------


def slow_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark, documents):
    docs = sorted((r["doc_id"], slow_fingerprint(r["text"])) for r in documents.collect())
    prints = np.array([p for _, p in docs], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    roots = classes(len(docs), zip(*np.nonzero(near)))
    want = sorted((d, f"{p:016x}", docs[r][0]) for (d, p), r in zip(docs, roots))
    assert sorted(tuple(r) for r in rows_of(spark, "op10_simhash_near_dedup")) == want


@pytest.fixture(scope="module")
def near_prints():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(120)]
    found = set(base) | {0, 1, (1 << 64) - 1}
    for b in base[:40]:
        x = b
        for _ in range(rng.randint(1, 30)):
            y = x
            for _ in range(rng.randint(1, 5)):
                y ^= 1 << rng.randrange(64)
            found.add(y)
            x = rng.choice([x, y, b])
    return np.array(sorted(found), dtype=np.uint64)


@pytest.mark.parametrize("block", [SH.BLOCK, 2])
def test_links_connect_as_all_pairs_do(spark, near_prints, block):
    signed = near_prints.view(np.int64).tolist()
    place = {v: i for i, v in enumerate(signed)}
    away = np.bitwise_count(near_prints[:, None] ^ near_prints[None, :])
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    links = [(place[r["u"]], place[r["v"]]) for r in SH.near_links(df, block=block).collect()]
    assert all(0 < away[i, j] <= 3 for i, j in links)
    assert classes(len(signed), links) == classes(len(signed), zip(*np.nonzero(away <= 3)))


def test_links_across_small_batches(near_prints):
    """Groups that fall into several Arrow batches lose nothing."""
    import pandas as pd

    rows = [(0, 7, 0, 0, int(v)) for v in near_prints[:60].view(np.int64)]
    rows += [(0, 7, 0, 1, int(v)) for v in near_prints[60:].view(np.int64)]
    frame = pd.DataFrame(rows, columns=["stretch", "anchor", "block", "away", "fp"])
    whole = set()
    for size in (1, 7, 1000):
        parts = [frame.iloc[i : i + size] for i in range(0, len(frame), size)]
        found = pd.concat(list(SH._compare(3)(iter(parts))) or [pd.DataFrame({"u": [], "v": []})])
        place = {int(v): i for i, v in enumerate(near_prints.view(np.int64))}
        got = classes(len(near_prints), [(place[int(u)], place[int(v)]) for u, v in found.to_numpy()])
        whole.add(tuple(got))
    assert len(whole) == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 300)] + [(500, 400), (400, 450), (7, 7)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    roots = {r["u"]: r["root"] for r in CO.connected_components(df).collect()}
    assert roots == {**{i: 0 for i in range(1, 101)}, **{i: 200 for i in range(201, 300)}, 500: 400, 450: 400}


# --- mixing ------------------------------------------------------------------


def slow_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, fixed = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(2 * sizes[i] for i in fixed)
        level = left / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if weights[i] * level > 2 * sizes[i]}
        if not over:
            return [2 * s if i in fixed else weights[i] * level for i, s in enumerate(sizes)]
        fixed |= over


def test_mix_query(spark, documents):
    docs = {r["doc_id"]: r for r in documents.collect()}
    rows = {r["doc_id"]: r for r in rows_of(spark, "op3_mix_sources")}
    assert rows.keys() == docs.keys()
    sizes, taken = {}, {}
    for i, r in docs.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert rows[i]["size"] == n and rows[i]["taken"] <= 2 * n
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        taken[r["source"]] = taken.get(r["source"], 0) + rows[i]["taken"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, slow_targets([sizes[s] for s in names])))
    for i, r in docs.items():
        assert rows[i]["source_size"] == sizes[r["source"]]
        assert rows[i]["target"] == pytest.approx(targets[r["source"]], rel=1e-12)
    for s in names:
        assert abs(taken[s] - targets[s]) <= 0.5001


def test_mix_shards_get_their_quota(documents):
    rows = MI.mix_sources(documents, shards=4, block_words=200).collect()
    uses = [s for r in rows if r["shards"] for s in r["shards"]]
    assert set(uses) == {0, 1, 2, 3}
    per_block = MI.mix_sources(documents, shards=4, block_words=200).select("shards").distinct().count()
    assert per_block > 4


def test_written_mix_has_the_words_taken(documents):
    taken = sum(r["taken"] for r in MI.mix_sources(documents).collect())
    texts = [r["text"] for r in MI.write_mix(documents).collect()]
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts) == taken


# --- packing -----------------------------------------------------------------


def test_first_fit_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 300))]
        room, want = [], [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((j for j, r in enumerate(room) if r >= sizes[i]), None)
            if at is None:
                room.append(100)
                at = len(room) - 1
            want[i] = (at, 100 - room[at])
            room[at] -= sizes[i]
        where, offsets = PA.first_fit_decreasing(sizes, 100)
        assert list(zip(where, offsets)) == want


def test_filled_rooms_keep_every_piece():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        sequences = PA.fill_rooms(sizes, 100, least=1)
        held = {}
        for sequence in sequences:
            assert sum(n for _, _, n in sequence) <= 100
            for piece, start, n in sequence:
                held.setdefault(piece, []).append((start, n))
        for i, size in enumerate(sizes):
            at = 0
            for start, n in sorted(held[i]):
                assert start == at and n > 0
                at += n
            assert at == size
        assert len(sequences) == -(-sum(sizes) // 100)


def test_words_tokenise_as_whole_texts(documents):
    from tokenizers import Tokenizer

    path = PA.default_tokenizer()
    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        words = PA.WordTokenizer(file.read(), remembered=30)
    rng = random.Random(4)
    letters = list("aB'sStT \t\n\x0b12 .é́ΣσİK'l<|>  日\x85\x1c")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> foo<|startoftext|>bar", "ΑΣ ΟΔΟΣ", *[r["text"] for r in documents.collect()]]
    for text in texts:
        got = np.frombuffer(words.encode(text), "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [100_000, 500])
def test_words_are_looked_up_without_a_step_for_each(remembered):
    from tokenizers import Tokenizer

    path = PA.default_tokenizer()
    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        words = PA.WordTokenizer(file.read(), remembered)
    rng = random.Random(7)
    letters = "aeioulnrstdéüÀ"
    texts = [" ".join("".join(rng.choices(letters, k=6)) + rng.choice(["", "", ",", "."]) for _ in range(2000)) for _ in range(10)]
    want = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    steps = 0

    def traced(frame, event, arg):
        nonlocal steps
        steps += frame.f_code.co_filename == PA.__file__ and event == "line"
        return traced

    for _ in range(2):
        sys.settrace(traced)
        try:
            got = list(words.encode_many(texts))
        finally:
            sys.settrace(None)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == want
    assert steps < 2000  # of 40,000 words
    assert len(words.parts) <= 2 * remembered


def test_nothing_to_tokenise_and_long_words():
    from tokenizers import Tokenizer

    path = PA.default_tokenizer()
    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        words = PA.WordTokenizer(file.read(), remembered=40)
    assert list(words.encode_many([])) == []
    assert list(words.encode_many(["", " \n", ""])) == [b"", b"", b""]
    texts = ["a" * 9000 + "!!", "", "-" * 5000 + "a" + "é" * 3000, "x,y 1." * 50, "", "日本語" * 700]
    for _ in range(3):
        got = list(words.encode_many(texts))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert words.parts.nbytes <= 2 * 40 * PA.ENTRY_BYTES


def test_added_tokens_of_letters_keep_the_whole_tokenizer():
    import json

    with open(PA.default_tokenizer(), encoding="utf-8") as file:
        shape = json.load(file)
    words = PA.WordTokenizer(json.dumps(shape))
    assert words.letters is not words.tokenizer
    shape["added_tokens"].append(shape["added_tokens"][0] | {"id": 49408, "content": "stop"})
    words = PA.WordTokenizer(json.dumps(shape))
    assert words.letters is words.tokenizer
    assert np.frombuffer(words.encode("a stop, b"), "<u4").tolist() == words.tokenizer.encode("a stop, b", add_special_tokens=False).ids


def test_pack_query(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PA.default_tokenizer())
    ids = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in documents.collect()}
    rows = rows_of(spark, "op2_pack_sequences")
    at, held = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] = r["start"] + r["length"]
        part = np.array(ids[r["doc_id"]][r["start"] : at[r["doc_id"]]], dtype="<u4").tobytes()
        assert zlib.crc32(part) == r["ids_crc32"]
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {d: len(i) for d, i in ids.items()}
    padding = 0
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        padding += 4096 - end
    assert padding < 4096


# --- language ----------------------------------------------------------------


def test_languages_of_held_out_documents(spark, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = rows_of(spark, "op5_language_id")
    assert {r["doc_id"] for r in rows} == lang.keys()
    tested = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested)
    assert right >= 0.97 * len(tested)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)


FOREIGN = {
    "Russian": "Этот город стоит на реке и в нём живут люди которые любят читать книги ",
    "Greek": "Η πόλη είναι μεγάλη και οι άνθρωποι διαβάζουν βιβλία κάθε μέρα ",
    "gibberish": "xqzvk wqjx zzkq vxwq jjqz kxvw qzxj wvkx ",
}


def test_foreign_texts_of_all_lengths_are_rejected(spark, documents):
    rare = spark.createDataFrame([(-i, f"lorem ipsum dolor {i}a sit amet", "la", "x") for i in range(1, 6)], "doc_id bigint, text string, lang string, source string")
    model = LA.fit(documents.select(*rare.columns).union(rare))
    own = [r["text"] for r in documents.filter("length(text) > 40000").limit(2).collect()]
    own += [r["text"] for r in documents.filter("length(text) between 1000 and 3000").limit(4).collect()]
    texts = [(t[:n], False) for t in own for n in (60, 400, 50_000)]
    texts += [((t * (n // len(t) + 1))[:n], True) for t in FOREIGN.values() for n in (8, 40, 90, 1000, 5000, 60_000)]
    df = spark.createDataFrame(texts, "text string, foreign boolean")
    for r in df.select(df["text"], "foreign", LA.identify(model, df["text"]).alias("f")).collect():
        assert r["f"]["rejected"] == r["foreign"], (r["text"][:60], len(r["text"]), r["f"])
    assert model.languages == ["de", "en", "es", "fr", "la"]
    assert all(model.floors[i, size] > 0 for i in range(5) for size in range(20))


# --- licences ----------------------------------------------------------------


def test_matching_statistics_and_phrases():
    rng = random.Random(5)
    letters = "a b c d".split()
    templates = [
        LS.Template(f"x{i}", " ".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))) for i in range(8)
    ]
    automaton = LS.Automaton(templates[:4], templates[4:], 3, 2, 0.8)
    bodies = [t.text.split() for t in templates]

    def occurs(run):
        return any(run == b[i : i + len(run)] for b in bodies for i in range(len(b)))

    for _ in range(500):
        words = [rng.choice([*letters, "z"]) for _ in range(rng.randint(0, 25))]
        found = automaton.statistics([automaton.vocabulary.get(w.encode(), -1) for w in words])
        for i in range(len(words)):
            assert found[i][1] == max(k for k in range(i + 2) if k == 0 or occurs(words[i - k + 1 : i + 1]))
        want = sorted(
            (i, i + len(b) - 1) for b in bodies[4:] for i in range(len(words) - len(b) + 1) if words[i : i + len(b)] == b
        )
        assert sorted((s.first, s.last) for s in automaton.scan(" ".join(words))[1] if s.base) == want


def test_chains_cover_templates():
    automaton = LS.Automaton(LS.TEMPLATES, LS.BASE_PHRASES, LS.LONG, LS.GAP, LS.COVERED)
    words = LS.TEMPLATES[0].text.split()
    changed = " ".join([*words[:20], "by", "all", "means", *words[22:]])
    _, spans = automaton.scan(f"// intro\n{changed}\n// more")
    assert [(s.label, s.first, s.base) for s in spans] == [("mit", 1, False)] and 0.8 <= spans[0].coverage < 1
    assert automaton.scan("a copy of this software and of the license under the sun")[1] == []


def test_license_query(spark, documents):
    phrases = {p.label: p.text.split() for p in LS.BASE_PHRASES}
    rows = {r["doc_id"]: r for r in rows_of(spark, "op7_license_scan")}
    for r in documents.collect():
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [
            (i, label)
            for label, p in phrases.items()
            for i in range(len(words) - len(p) + 1)
            if words[i : i + len(p)] == p
        ]
        got = rows[r["doc_id"]]
        starts = [i for i, _ in places]
        assert (got["n_words"], got["n_base"]) == (len(words), len(places))
        assert (got["first_word"], got["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert got["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(got["base_labels"].split(",")) - {""} <= set(got["labels"].split(","))
        assert 0 <= got["score"] <= 1


# --- main text ---------------------------------------------------------------


def test_main_text_query(spark, pages):
    from html import unescape

    got = {r["page_id"]: r for r in rows_of(spark, "op8_html_text")}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (text, len(text))


LONG_TEXT = "It is the story of a town and of the people in it, and as it is long it is told in all its parts to the end."


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("<p", ""),
        ("<!-- open <p>no", ""),
        ("plain &lt;text&gt; &#65;&#x42;", "plain <text> AB"),
        ("<p>One<br>line<br><br>next", "One line\nnext"),
        (f"<nav><a>Home</a></nav><article><h1>Title</h1><p>{LONG_TEXT}</p><p>Short.</p></article><footer>x</footer>", f"Title\n{LONG_TEXT}\nShort."),
        (f"<div class='ad'>Buy<article><p>{LONG_TEXT}</p></article>", LONG_TEXT),
        (f"<main><p>{LONG_TEXT}</p><div id='comments'><article><p>{LONG_TEXT} I say</p></article></div></main>", LONG_TEXT),
        (f"<main><p class='cookie-notice'>We use them</p><div class='no-sidebar'>{LONG_TEXT}</div><form>Mail <button>Go</button></form></main>", LONG_TEXT),
        (f"<body><p>{LONG_TEXT * 3}</p><p>So it is.</p><ul><li><a>Link one</a></li><li><a>Link two</a></li></ul><p><a>More</a></p>", f"{LONG_TEXT * 3}\nSo it is."),
        ("<script>if (a < b) document.write('<p>x</p>')</script><p>yes</p><style>p{}</style>", "yes"),
    ],
)
def test_main_text_of_small_pages(html, text):
    assert HT.main_text(html) == text


PROSE = LONG_TEXT * 3
NAMES = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Omikron Rho Sigma Tau Ypsilon"


@pytest.mark.parametrize(
    "html,text",
    [
        # Teasers in a closed aside are not the page's text.
        (f"<body><div><p>{PROSE}</p></div><aside><article><h3>Teaser</h3></article></aside>", PROSE),
        (f"<div><p>{PROSE}</p></div><aside><article><p>{LONG_TEXT}</p></article>{LONG_TEXT}</aside><p>{PROSE}</p>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{LONG_TEXT}</p></article><div class='related'><article><p>{LONG_TEXT}</p></article></div>", LONG_TEXT),
        (f"<nav><article><p>{LONG_TEXT}</p></article></nav><main><p>{LONG_TEXT}</p></main>", LONG_TEXT),
        # An article of a few words leaves the page to the rules for all blocks.
        (f"<p>{PROSE}</p><article><h3>Teaser</h3></article>", f"{PROSE}\nTeaser"),
        # Blocks outside an article are judged: text stays; lists of names and of links go.
        (f"<p>{PROSE}</p><article><p>{LONG_TEXT}</p></article><p>{NAMES}</p><p><a>{PROSE}</a></p>", f"{PROSE}\n{LONG_TEXT}"),
        # Elements that hold the whole page, or are never closed, do not hide its article.
        (f"<form id='all'><article><p>{LONG_TEXT}</p></article></form>", LONG_TEXT),
        (f"<div class='with-x widget'><article><p>{LONG_TEXT}</p></article></div>", LONG_TEXT),
        (f"<aside>Buy<article><p>{LONG_TEXT}</p></article>", LONG_TEXT),
    ],
)
def test_main_text_where_articles_mislead(html, text):
    assert HT.main_text(html) == text


def test_two_passes_find_the_article_without_its_element(pages):
    want = found = 0
    for r in pages.collect():
        lines = HT.main_text(r["html"]).split("\n")
        judged = HT.main_text(re.sub(r"<(/?)article>", r"<\1div>", r["html"])).split("\n")
        assert set(judged) <= {*lines, ""}
        want += sum(map(len, lines))
        found += sum(map(len, judged))
    assert found >= 0.9 * want


# --- URL filters -------------------------------------------------------------


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame(
        [(i, f"http://{h}.example.net/en/{i}") for i, h in enumerate(["a", "b", "c"])] + [(9, "http://x.org/rare/y")],
        "page_id bigint, url string",
    )
    rules = [UF.address_rule("example.net/en/", "allow"), UF.address_rule("x.org/rare/", "block"), UF.word_rule("en-rare")]
    host, path = UF.address_columns(pages["url"])
    table = spark.createDataFrame(
        [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules],
        "rule string, verdict string, pattern string, tokens array<string>, rank bigint",
    )
    filed = {r["rule"]: r["token"] for r in UF.rule_index(pages.select(host.alias("host"), path.alias("path")), table).collect()}
    assert filed == {"example.net/en/": "en", "x.org/rare/": "org", "en-rare": "rare"}


def test_join_judges_as_the_index_does(pages):
    rules = (*UF.BASE_RULES, *UF.WORD_RULES)
    small = sorted(map(tuple, UF.judge_urls(pages, rules).collect()), key=str)
    large = sorted(map(tuple, UF.judge_urls(pages, rules, max_indexed=0).collect()), key=str)
    assert small == large
