"""Prefix tries, token counts and centroid clustering against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import public_tokenizers
import pytest

from sparkdraft.llm import clustering as CL
from sparkdraft.llm import prefix_trie as PT
from sparkdraft.llm import token_counts as TC

TURNS = "conv_id bigint, turn bigint, role string, text string"


# --- prefix tries ------------------------------------------------------------


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def conversations_of(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            found.setdefault(conv, []).append((turn is not None, turn or 0, digest(role, text), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in found.items()}


def plain_branched(own):
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        found[c] = own.get(base, [])[:h] + turns[h:]
    return found


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) or 1
        last = len(path[-1][1].encode()) if path else 0
        saved[path] = sum(saved[b] for b in below) + (len(members[path]) - 1) * last
    rows = []
    for path, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(held), len(path), parent, len(held), len(children.get(path, [])), leaves[path], saved[path], sha))
    return sorted(rows, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_conversations(seed, longest):
    rng = random.Random(seed)
    rows = []
    shared = [("user", f"turn {i} é" * rng.randint(0, 3)) for i in range(longest)]
    for c in range(-7, 40):
        own = shared[: rng.randint(0, longest)] if rng.random() < 0.6 else []
        own = own + [("assistant", rng.choice(["", "a", "b", "ß"])) for _ in range(rng.randint(0, 4))]
        rows += [(c, t, *turn) for t, turn in enumerate(own)]
    rows += [(100 + i, t, *turn) for i in range(60) for t, turn in enumerate(shared)]
    rows += [(None, 1, "user", "x"), (200, None, None, None), (200, None, "user", None), (200, 3, "u", "t"), (200, 3, "u", "t")]
    rows += [(201, 3, "ab", "c"), (202, 3, "a", "bc"), (203, 1, "user", "z" * 300_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, shard_turns, longest", [(64, 200_000, 12), (3, 7, 12), (2, 1, 30), (64, 50, 150)])
def test_trie_as_a_plain_one(spark, size, shard_turns, longest):
    rows = some_conversations(size, longest)
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as digest", "1 as pos", "2 as conv", "3 as n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = got(PT.prefix_trie(df, size=size, shard_turns=shard_turns))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain_trie(conversations_of(rows))


@pytest.mark.parametrize("size", [64, 2])
def test_rebuilt_conversations(spark, size):
    rows = some_conversations(5, 10)
    turns, ids = PT.branched(PT.ordered_turns(spark.createDataFrame(rows, TURNS)))
    assert got(PT.build_trie(turns, ids, size)) == plain_trie(plain_branched(conversations_of(rows)))


def test_turnless_conversations_and_none(spark):
    # 7 has fewer turns than its head takes, and 5 is absent.
    rows = [(c, 0, "user", "x") for c in range(7, 10)]
    turns, ids = PT.branched(PT.ordered_turns(spark.createDataFrame(rows, TURNS)))
    want = plain_trie(plain_branched(conversations_of(rows)))
    assert got(PT.build_trie(turns, ids)) == want and any(r[1] == 0 and r[3] == 3 for r in want)
    for empty in ([], [(None, 0, "user", "x")]):
        turns, ids = PT.branched(PT.ordered_turns(spark.createDataFrame(empty, TURNS)))
        assert got(PT.build_trie(turns, ids)) == []
        assert got(PT.prefix_trie(spark.createDataFrame(empty, TURNS))) == []


def test_trees_are_balanced():
    forest = PT.Forest()
    root = forest.node(-1, -1)
    for i in PT.medians(0, 1023):
        forest.insert(root, [i, 0])
    deepest, stack = 0, [(forest.links[1], 1)]
    while stack:
        at, level = stack.pop()
        if at >= 0:
            deepest = max(deepest, level)
            stack += [(forest.links[3 * at], level + 1), (forest.links[3 * at + 2], level + 1)]
    assert deepest == 10
    assert [forest.code[i] for i in forest.traverse(root)] == [x for i in range(1023) for x in (i, 0)]


# --- token counts ------------------------------------------------------------

ODD_TEXTS = [
    None, "", " ", "a  b   c ", " lead", "tab\tand\nline\r\n\n end", "It's don't WE'LL 's", "<|endoftext|>",
    "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "J̌ T̈ H̱ Á é", "日本語 テキスト", "a b c",
    "\x00 \x1c\x1d\x85x \x0b\x0c", "▁a ▁ a▁b", "🙂👍🏽 " * 40, "word " * 30_000, "z" * 20_000, "1234 5.678, (x)-[y]", "İstanbul ǅ ß ﬁ",
    "a ́b", "  two", "two  ", "Ünï çödé, naïve. café!", "a . b ! c ?", "﻿bom ​ zero", "a's 'tis 'S",
]


def library_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("sizes", [{}, {"most": 0, "remembered": 3}, {"most": 20, "share": 0.01}])
def test_counts_are_the_librarys(spark, documents, name, sizes):
    texts = ODD_TEXTS + [r["text"] for r in documents.orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "'x' as n_tokens", "7 as word")
    found = {r["id"]: r["n_tokens"] for r in TC.count_tokens(df.repartition(5), public_tokenizers.path(name), **sizes).collect()}
    assert [found[i] for i in range(len(texts))] == library_counts(name, texts)


def test_known_tokenizers_are_cut():
    cuts = {}
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as file:
            cuts[name] = TC.Tokenizer(file.read(), name.endswith(".json")).cut
    assert list(cuts.values()) == [TC._words, TC._spaced, TC._unspaced]


def test_other_shapes_are_not_cut():
    assert TC.Tokenizer._json_cut({"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": True}}) is TC._whole
    assert TC.Tokenizer._json_cut({"pre_tokenizer": {"type": "Metaspace"}}) is TC._whole


def test_counting_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert TC.count_tokens(empty, TC.default_tokenizer()).collect() == []
    nulls = spark.createDataFrame([(None, None), (1, None)], "doc_id bigint, text string")
    assert sorted(r["n_tokens"] for r in TC.count_tokens(nulls, TC.default_tokenizer()).collect()) == [0, 0]


def test_heavy_words_are_found_in_bounded_memory():
    class Plain:
        cut = staticmethod(lambda t: t.encode().split())

    texts = [" ".join([f"rare{i}x{j}" for j in range(50)] + ["often"] * 5) for i in range(2000)]
    heavy = dict(TC.heavy_words(Plain, iter([texts]), share=0.01))
    assert set(heavy) == {b"often"} and heavy[b"often"] == 10_000


def test_op12_whole_table(spark, documents):
    rows = {r["doc_id"]: r for r in TC.op12(documents).collect()}
    docs = documents.collect()
    want = library_counts("word_bpe_49k.json", [d["text"] for d in docs])
    assert len(rows) == len(docs)
    for d, n in zip(docs, want):
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((d["text"] or "").encode()), n > 2048)


# --- clustering --------------------------------------------------------------


def plain_clusters(rows, dims, clusters, rounds):
    kept = [
        (i, [floor(1024 * Fraction(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and abs(x) < inf for x in v)
    ]
    seeds = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for *_, v in seeds[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [
            [sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)
        ]
    found = [(i, *reversed(near(v))) for i, v in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for n in range(len(centroids))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fit = lambda x: x if x < 2**63 else None
    rows = [(i, n, fit(d), fit(inertia[n]) if all(x < 2**63 for _, m, x in found if m == n) else None,
             fit(sum(inertia.values())) if all(x < 2**63 for *_, x in found) else None, shas[n]) for i, n, d in found]
    return sorted(rows, key=repr), centroids


def vectors(seed, n, dims, scale):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 2) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        rows.append((i, [float(np.float32(scale * (x + rng.gauss(0, 0.5)))) for x in c]))
    rows += [rows[0], rows[1], (None, rows[2][1]), (5, rows[3][1]), (n, [0.0] * dims), (n + 1, [-0.0] * dims)]
    rows += [(n + 2, None), (n + 3, []), (n + 4, [nan] + [0.0] * (dims - 1)), (n + 5, [None] + [0.0] * (dims - 1))]
    rows += [(n + 6, [inf] * dims), (n + 7, [-inf] * dims), (n + 8, [1.0] * (dims + 1))]
    return rows


@pytest.mark.parametrize(
    "kind, dims, clusters, scale",
    [("float", 64, 8, 0.1), ("float", 4, 3, 100.0), ("float", 6, 40, 1.0), ("double", 5, 4, 1e6), ("float", 3, 4, 1e30), ("double", 3, 4, 1e300)],
)
def test_clusters_as_plain_ones(spark, kind, dims, clusters, scale):
    rows = vectors(dims, 150, dims, 1.0 if kind == "double" else scale)
    if kind == "double":
        rows = [(i, v and [x and x * scale for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").selectExpr("*", "1 as id", "'x' as cluster", "2 as vector")
    found, centroids = CL.cluster_vectors(df.repartition(4), dimensions=dims, clusters=clusters)
    want, held = plain_clusters(rows, dims, clusters, 10)
    assert centroids == held
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_few_vectors_and_none(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [2.0, 3.0]), (1, [2.0, 3.0]), (2, [0.0, -1.0])]):
        found, _ = CL.cluster_vectors(spark.createDataFrame(rows, kind), dimensions=2)
        assert sorted(map(tuple, found.collect()), key=repr) == plain_clusters(rows, 2, 8, 10)[0]


@pytest.mark.parametrize("spread", [3, 1000, 2**30])
def test_search_finds_the_nearest(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread, (300, 4))
    centroids = rng.integers(-spread, spread, (25, 4)).tolist()
    centroids[7] = centroids[3]
    number, distance = CL.nearest(points if spread < CL._SMALL else points.astype(object), centroids)
    for p, n, d in zip(points.tolist(), number.tolist(), distance.tolist()):
        assert (d, n) == min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(centroids))
