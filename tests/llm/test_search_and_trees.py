"""Hard negatives, tree concatenation and ranked search against brute force: nulls, ties, repeats, long texts, clashes."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from maskframe.llm import lexical, negatives, tokens, treebpe

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# Hard negatives


def brute_negatives(rows):
    held = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for i, l, v in {(i, l, tuple(v)) for i, l, v in held if i % 100 == 0}:
        same = sorted((-dot(v, w), j) for j, m, w in held if m == l and j != i)[:5]
        for p, j in sorted(set(same)):
            some = sorted((-s, n) for s, n in ((dot(v, w), n) for n, m, w in held if m != l) if 30 * -p <= 100 * s <= 90 * -p)[:10]
            out += [(i, j, rank + 1, n, -p, -s) for rank, (s, n) in enumerate(some)]
    return sorted(out)


def vectors():
    chance = random.Random(3)
    rows = [(i, chance.choice([0, 1, 1, 1, 2]), [chance.gauss(0.3, 0.5) for _ in range(6)]) for i in range(900)]
    rows += [(i, 3, [0.5] * 6) for i in range(900, 960)]  # ties
    rows += [rows[5], rows[5], rows[100], rows[100]]  # repeated rows, an anchor too
    rows += [(None, 1, [1.0] * 6), (1001, None, [1.0] * 6), (1002, 1, None), (1003, 1, [1.0, None] * 3), (1004, 1, [math.nan] * 6), (1100, 1, [math.inf] * 6)]
    return rows + [(1005, 1, [1.0, 1.0]), (1200, 2, []), (1300, 2, [0.0] * 6), (1400, 9, [2.0] * 6)]  # short, empty, zero, alone


@pytest.mark.parametrize("tree_bytes", [negatives.TREE_BYTES, 6 * 8 * 300])
def test_negatives_equal_brute_force(spark, tree_bytes):
    rows = vectors()
    table = spark.createDataFrame([(*row, "clash", 1, 2.0) for row in rows], "vec_id long, label int, embedding array<float>, id string, tree int, score double").repartition(3)
    rows = [(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows]
    key = table.vec_id
    label = negatives.F.when(key % 7 == 0, (table.label + 1) % 10).otherwise(table.label)
    got = negatives.mine(table, key % 100 == 0, label, tree_bytes=tree_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_empty_and_too_large(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.contract(spark.createDataFrame([], schema)).collect() == []
    assert negatives.contract(spark.createDataFrame([(1, 1, [1.0])], schema)).collect() == []
    with pytest.raises(ValueError, match="2\\*\\*53"):
        negatives.contract(spark.createDataFrame([(100, 1, [1e20])], schema))


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_ball_tree_prunes_and_stays_exact(spread):
    chance = np.random.default_rng(5)
    centres = chance.normal(0, 50, (8, 4))
    vectors = np.floor(centres[chance.integers(0, 8, 4000)] + chance.normal(0, 50 * spread, (4000, 4)))
    ids, labels = np.arange(4000), chance.integers(0, 5, 4000)
    tree = negatives.BallTree.load(negatives.BallTree(vectors, ids, labels, leaf=16).dump())
    queries, own, mine = vectors[:40], ids[:40], labels[:40]
    low, high = np.full(40, -1e4), np.full(40, 8e3)
    for same, k in ((True, 5), (False, 10)):
        j, found, scores = tree.search(queries, mine, own, np.arange(40), low, high, k, same)
        for q in range(40):
            every = [(-s, i) for i, s in enumerate((vectors @ queries[q]).tolist()) if -1e4 <= s <= 8e3 and ((labels[i] == mine[q] and i != own[q]) if same else labels[i] != mine[q])]
            assert [(-s, i) for i, s in zip(found[j == q].tolist(), scores[j == q].tolist(), strict=True)] == sorted(every)[:k]


# Tree concatenation

POOL = ["'s", "'re", "'", "'ll", "a", "the", "aaaa", "World", " ", "  ", "\n", "é", "é", "́", "漢", "İ", "J̌", "12", "!!", "...", "ñ", "x" * 30, "<|", "|>", "<|endoftext|>", "\U0001f600", "ᄀ", "ᅡ", "\x85", "_"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(WORD_BPE)


def joined(text: str, segment: int, joiner: treebpe.Joiner) -> list[int]:
    encoder, out = tokens.Encoder(WORD_BPE), []
    for part in encoder.parts(text.encode()):
        if isinstance(part, int):
            out.append(part)
        else:
            whole = encoder.tokenizer.normalizer.normalize_str(part.decode()).encode()
            places = treebpe.cuts(whole, segment)
            out += joiner.tree(whole, places, [joiner.leaf(whole[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]).tolist()
    return out


def test_joins_equal_the_library(library):
    chance, joiners = random.Random(1), [treebpe.Joiner(WORD_BPE, w) for w in (4, 16, 64)]
    for n in range(600):
        some = chance.sample(POOL, chance.choice([1, 2, 3, len(POOL)]))
        text = "".join(chance.choices(some, k=chance.randrange(120)))
        if n % 4 == 0:
            text = "".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=chance.randrange(400)))
        want = library.encode(text, add_special_tokens=False).ids
        assert joined(text, chance.choice([4, 7, 13, 40]), chance.choice(joiners)) == want, text
        assert tokens.Encoder(WORD_BPE)([text.encode()])[0].tolist() == want, text


def test_joins_within_a_word_are_local(library):
    """A word of 200,000 letters: the windows stay small, so that few bytes are encoded again."""
    text = "".join(random.Random(2).choices("etaoinshrdlu", k=200_000))
    joiner, again = treebpe.Joiner(WORD_BPE), []
    places = treebpe.cuts(text.encode(), 10_000)
    leaves = [joiner.leaf(text[a:b].encode()) for a, b in zip(places[:-1], places[1:], strict=True)]
    leaf = joiner.leaf
    joiner.leaf = lambda part: again.append(len(part)) or leaf(part)
    assert joiner.tree(text.encode(), places, leaves).tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(again) < 20_000


def test_documents_equal_the_library(spark, library):
    chance = random.Random(4)
    texts = [None, "", " \n\t ", "a", "Short text, it's one.", "don't <|endoftext|> stop<|startoftext|>", "w" * 60_000, "<|endoftext|>" * 20, "漢字" * 300, "".join(chance.choices(POOL, k=4000)), "it's " * 2000, "=" * 900]
    rows = [(i, text, "clash", "clash", 1) for i, text in enumerate(texts)] + [(None, texts[9], "", "", 0)] + [(4, texts[4], "", "", 0)] * 2 + [(9, texts[9], "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, key string, part int").repartition(3)
    got = treebpe.decode(treebpe.encode(docs, WORD_BPE, segment=64, window=4), WORD_BPE).collect()
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    order = lambda row: (row[0] is None, row)
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=order) == sorted(want, key=order)
    digest = {r.doc_id: r for r in treebpe.digests(docs.where("doc_id = 6"), WORD_BPE).collect()}[6]
    ids = library.encode(texts[6], add_special_tokens=False).ids
    assert (digest.n_tokens, digest.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert treebpe.digests(docs.limit(0), WORD_BPE).collect() == []


# Ranked search


def brute_ranks(docs, items, k=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    cut = lambda text: find("".join(c.lower() if c.isascii() else c for c in text or ""))
    split = [(i, Counter(cut(text))) for i, text in docs]
    sizes = [sum(c.values()) for _, c in split]
    n_docs, total, df = sum(map(bool, sizes)), sum(sizes), Counter(word for _, c in split for word in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        ranked = []
        for (i, c), n in zip(split, sizes, strict=True):
            m = 10 + 90 * n * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(cut(text)) if w in c)
            if score > 0:
                ranked.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


@pytest.fixture(scope="module")
def library_of_texts():
    chance = random.Random(6)
    words = [f"Wörd{i}" for i in range(60)] + ["É", "é", "x1", "日本"]
    docs = [(i, " ".join(chance.choices(words, weights=[1 / (n + 1) for n in range(len(words))], k=chance.randrange(1, 80)))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in range(400, 450)]  # copies: ties over all blocks
    docs += [(7, docs[7][1]), (None, docs[7][1]), (900, None), (901, ""), (902, "-- !?"), (903, "rare " * 30_000)]
    items = [(i, " ".join(chance.choices(words, k=chance.randrange(1, 30)))) for i in range(12)]
    items += [(20, docs[7][1]), (21, None), (22, ""), (23, "?!"), (24, "unknown"), (25, "RARE rare"), (0, "wörd1 É"), (20, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000}, {"block_bytes": 500, "shares": (0.3,)}, {"block_bytes": 3000, "shares": ()}, {"item_bytes": 600, "k": 3}])
def test_search_equals_brute_force(spark, library_of_texts, options):
    docs, items = library_of_texts
    table = spark.createDataFrame([(*row, 1, "clash") for row in docs], "doc_id long, text string, block int, item string").repartition(4)
    asked = spark.createDataFrame([(*row, "clash") for row in items], "item_id long, text string, doc_id string")
    got = lexical.search(table, asked, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1], r[3])) == brute_ranks(docs, items, options.get("k", 10))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.selectExpr("doc_id", "'.' AS text"), items).collect() == []


def test_items_fall_through_only_without_proof(spark):
    """One document has the item's rare terms: blocks without it are out after the first tier."""
    rows = [(i, f"common words of every text number{i} {'filler ' * 20}") for i in range(400)] + [(1000, "alpha beta gamma delta common")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    words = sorted(set(lexical.terms("alpha beta gamma delta common words")))
    raw = lexical.postings(docs, words, "doc_id", "text", 4000)
    n, total = raw.selectExpr("sum(docs)", "sum(total)").first()
    df = {r.term: r.df for r in raw.selectExpr("inline(dfs)").groupBy("term").agg({"df": "sum"}).toDF("term", "df").collect()}
    tiers = lexical.index(raw, n, total, np.array([lexical.weight(n, df.get(i, 0)) for i in range(len(words))]), (0.5,))
    item = [np.arange(len(words))]
    floor = lexical.floors(tiers, item, 1)
    found = lexical.ranked_blocks(tiers, item, floor, 1).collect()
    assert [r.doc for r in found] == [1000] and tiers.count() > 5
