"""The pipeline's near-duplicates against all pairs of five-word shingle sets."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np

import corpus_pipeline
from maskframe.llm import common, minhash


def sets_of(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    x, y = sets_of(a), sets_of(b)
    return x == y or (bool(x | y) and len(x & y) * 5 >= len(x | y) * 4)


def near_copies():
    """Texts of 60 to 400 words, copies of them with a few words replaced, and chains of copies of copies."""
    chance = random.Random(11)
    rows = []
    for _ in range(40):
        words = [f"w{chance.randrange(5000)}" for _ in range(chance.randrange(60, 400))]
        for _ in range(4):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(chance.randrange(1, 2 + len(words) // 60)):
                words[chance.randrange(len(words))] = f"x{chance.randrange(5000)}"
    rows += ["one two", "One  two", "one three", None, "", "a b c d e"]
    ids = chance.sample(range(10_000), len(rows))
    return dict(zip(ids, rows, strict=True))


def test_near_copies_equal_all_pairs(spark, tmp_path):
    texts = near_copies()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and find(i) != find(j) and similar(texts[i], texts[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {find(i) for i in texts}


def test_parities_never_count_more_than_is_apart():
    chance = np.random.default_rng(3)
    for size in (0, 1, 50, 3000):
        for shared in (0, size // 2, size):
            x = chance.integers(0, 1 << 63, size, dtype=np.uint64)
            y = np.concatenate([x[:shared], chance.integers(0, 1 << 63, size - shared, dtype=np.uint64)])
            odd = minhash.parity(np.unique(x)) ^ minhash.parity(np.unique(y))
            assert np.bitwise_count(odd).sum() <= len(np.setxor1d(x, y))


def test_a_near_copy_beyond_two_bits_goes(spark, tmp_path):
    from test_operators import brute_print, graded

    text = dict(graded(200)[0])[4]
    copy = text + " token = abcdefgh"
    assert similar(text, copy) and (brute_print(text) ^ brute_print(copy)).bit_count() > 2
    docs = spark.createDataFrame([(4, text), (1002, copy)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()] == [4]


def test_balls_bring_similar_sets_together():
    chance = np.random.default_rng(7)
    for size, shared in ((5, 4), (60, 54), (300, 268)):
        for _ in range(20):
            x, y = chance.integers(0, 1 << 63, (2, size), dtype=np.uint64)
            y[:shared] = x[:shared]
            prints, free = minhash.balls([np.unique(x), np.unique(y)])
            assert not ((prints[0] ^ prints[1]) & ~(free[0] | free[1])).all()


def test_values_kept_cover_all_company():
    chance = np.random.default_rng(9)
    low, free, root = chance.integers(0, 1 << 6, 60, dtype=np.uint64), chance.integers(0, 1 << 4, 60, dtype=np.uint64), chance.integers(0, 9, 60)
    rows, values = minhash.flipped(low, free)
    for roots in (None, root):
        kept, at, _ = minhash.company(low, free, roots)
        pairs = [{(a, b) for v in set(found.tolist()) for a in of[found == v].tolist() for b in of[found == v].tolist() if a < b and (roots is None or root[a] != root[b])} for of, found in ((rows, values), (kept, at))]
        assert pairs[0] == pairs[1] and pairs[0]
        whole, of = minhash.merged(kept, at)
        assert all(((whole == a) & (of == v)).sum() <= 1 for a, v in zip(whole, of, strict=True))
        assert pairs[0] <= {(a, b) for v in set(of.tolist()) for a in whole[of == v].tolist() for b in whole[of == v].tolist()}


def test_near_copies_are_found_by_simhash_balls(spark, tmp_path, monkeypatch):
    """Without the balls no near copy goes: nothing beside them finds links."""
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = minhash._ball_pairs
    monkeypatch.setattr(minhash, "_ball_pairs", lambda rows, *more: found(rows.limit(0), *more))
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(frozenset(sets_of(texts[i])), i)
    assert left == set(first.values())


def test_a_large_group_makes_few_rows(spark, tmp_path, monkeypatch):
    """Copies of one text with 1 to 12 words replaced: they all meet, and not all are similar. No table that the stage
    writes has rows for their pairs, and the rows kept are those of all pairs."""
    chance = random.Random(12)
    base = [f"w{chance.randrange(5000)}" for _ in range(300)]
    texts = {}
    for i in range(400):
        words = list(base)
        for at in chance.sample(range(300), chance.randrange(1, 13)):
            words[at] = f"x{chance.randrange(5000)}"
        texts[i] = " ".join(words)
    sets, root = {i: sets_of(text) for i, text in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    written, write = {}, minhash.common.materialize

    def counted(df, tag):
        out = write(df, tag)
        written[tag] = max(written.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(minhash.common, "materialize", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert left == set(root.values()) and 1 < len(left) < 400
    assert max(written.values()) <= 10 * len(texts), written


def test_bounds_where_sets_meet_lose_no_similar_pair():
    chance = np.random.default_rng(13)
    base, found = chance.integers(0, 1 << 63, 200, dtype=np.uint64), []
    for _ in range(60):
        at = chance.permutation(200)[: chance.integers(0, 40)]
        found.append(base.copy())
        found[-1][at] = chance.integers(0, 1 << 63, len(at), dtype=np.uint64)
        found[-1] = np.unique(found[-1][chance.integers(0, 30) :])
    every, times = np.unique(np.concatenate(found), return_counts=True)
    own = [int(np.isin(x, every[times == 1]).sum()) for x in found]
    root = chance.integers(0, 5, 60)
    known = np.array([[r, len(x), o, *minhash.parity(x).view(np.int64)] for r, x, o in zip(root, found, own, strict=True)])
    similar_pairs = {(a, b) for a in range(60) for b in range(a) if root[a] != root[b] and len(np.intersect1d(found[a], found[b])) * 5 >= len(np.union1d(found[a], found[b])) * 4}
    rows, values = np.arange(60), np.zeros(60, np.uint64)
    pairs = {(max(p), min(p)) for p in minhash.crossing(rows, values, known, False).tolist()}
    assert similar_pairs and similar_pairs <= pairs and len(pairs) < 60 * 59 // 2
    hubs = {(max(p), min(p)) for p in minhash.crossing(rows, values, known, True).tolist()}
    assert hubs <= pairs


def test_divided_balls_keep_all_company():
    chance = np.random.default_rng(15)
    low, free = chance.integers(0, 1 << 6, 60, dtype=np.uint64), chance.integers(0, 1 << 4, 60, dtype=np.uint64)

    def met(rows, low, free):
        of, values = minhash.flipped(low, free)
        return {(int(v), int(rows[k])) for k, v in zip(of, values, strict=True)}

    parts = list(minhash.divided(low, free, 40))
    assert len(list(minhash.divided(low[:1], free[:1], 1))) == 2 ** int(free[0]).bit_count()
    assert len(parts) > 4 and all(len(part[0]) and len(minhash.flipped(*part[1:])[0]) <= 40 for part in parts)
    assert set().union(*(met(*part) for part in parts)) == met(np.arange(60), low, free)
    assert sum(len(met(*part)) for part in parts) == len(met(np.arange(60), low, free))


def test_small_tables_are_written_in_few_files(spark, tmp_path):
    """However wide shuffles are: each file written costs an executor two processes."""
    texts = {i: text for i, text in near_copies().items() if text}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    scratch = Path(common.shared_dir(spark).removeprefix("file:"), "maskframe")
    before = set(scratch.glob("*"))
    put = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        assert corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).count() < len(texts)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    written = [len(list(p.glob("part-*"))) for p in set(scratch.glob("*")) - before]
    assert len(written) > 10 and max(written) <= spark.sparkContext.defaultParallelism


def test_workers_give_back_what_tasks_freed():
    """Of 40,000 buffers every hundredth stays, so that allocators cannot shrink on their own; the rest goes back."""

    def resident():
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    left = []

    def run(batches):
        some = [bytes(4000) for _ in range(40_000)]
        left.extend(some[::100])
        yield from batches

    before = resident()
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 40
