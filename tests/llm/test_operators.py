"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from maskframe.llm import bpe, decontaminate, ordinal, registry, rules, secrets, simhash, suffixes, tokens, urls, warc
from maskframe.llm.wavelet import WaveletMatrix, dump

DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, block string"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box five dozen liquor jugs in a cellar"


def corpus():
    chance = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "délta", "don't", "1234", "x=1", "ñu", "e.g.", "Zeta"]
    prose = lambda n: " ".join(chance.choices(words, k=n))
    texts = [None, "", "   \n\t", "a", PASSAGE, PASSAGE, "Intro. " + PASSAGE + " Outro.", prose(60), prose(60), prose(3000), "aaaa" * 60, "aaaa" * 50, PASSAGE[:55], "é" * 40, "é" * 41]
    texts += [texts[7] + " tail", "line\nline\nother line\nline", prose(20) + "\n" + PASSAGE[10:90], "日本語 テキスト", "tab\tsep\x0bvt\x85nel em"]
    ids = chance.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash") for i, t in ROWS], DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def odd(spark):
    """A null id and a repeated row."""
    return spark.createDataFrame([(None, PASSAGE), (5, PASSAGE), (5, PASSAGE), (7, None)], "doc_id long, text string")


def test_suffixes_equal_brute_force(docs):
    data = [(i, (t or "").encode()) for i, t in ROWS]
    first: dict[bytes, int] = {}
    for i, x in data:
        for p in range(len(x) - 49):
            first[x[p : p + 50]] = min(first.get(x[p : p + 50], i), i)
    rows = {r.doc_id: r for r in suffixes.digests(docs).collect()}
    assert len(rows) == len(data)
    for i, x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        assert tuple(rows[i]) == (i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_suffix_blocks_of_any_size_agree(docs):
    a, b = (sorted(map(repr, suffixes.repeated(docs, block_bytes=n, buckets=k).collect())) for n, k in ((100, 2), (1 << 20, 5)))
    assert a == b


def test_blocks_are_hashed_in_pieces(monkeypatch):
    """Of a byte no more than a few numbers are held at once, and pieces of any size give the same runs."""
    chance = np.random.default_rng(2)
    text = chance.integers(97, 101, 300_000, dtype=np.uint8).tobytes() + b"ab" * 1000
    sizes = [1000, 0, 49, 50, 200_000, len(text) - 201_099]
    tracemalloc.start()
    block = suffixes.Block(list(range(6)), sizes, text, 50, 30, 5)
    most = tracemalloc.get_traced_memory()[1] / len(text)
    tracemalloc.stop()
    assert most < 50
    for size in (1000, 77, 1 << 20):
        monkeypatch.setattr(suffixes, "PIECE", size)
        other = suffixes.Block(list(range(6)), sizes, text, 50, 30, 5)
        assert all(np.array_equal(getattr(block, name), getattr(other, name)) for name in ("window", "first", "last", "digit", "whole", "rank"))
    assert (block.last - block.first < 21).all() and (block.last - block.first + 1).sum() == sum(max(n - 49, 0) for n in sizes)


def test_suffixes_of_odd_rows(odd, empty):
    rows = sorted(((r.doc_id or 99, r.n_removed) for r in suffixes.digests(odd).collect()))
    assert rows == [(5, 0), (5, 0), (7, 0), (99, len(PASSAGE))] and suffixes.digests(empty).count() == 0


def test_decontamination(spark, docs, empty):
    words = PASSAGE.split()
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, " ".join(words[10:] + words[:10])), (3, "too short"), (4, None), (None, PASSAGE)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, benchmark).collect()}
    whole = {i for i, t in ROWS if t and PASSAGE in t}
    assert {i for i, item in found if item == 1} >= whole and {i for i, item in found if item == 2} >= whole
    assert all(found[i, 1].coverage == 1 and found[i, 1].n_tiles == 1 and found[i, 2].n_tiles == 2 for i in whole)
    assert not {i for i, _ in found} & {i for i, t in ROWS if not t or "fox" not in t}
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - len({i for i, _ in found})
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    blocked = decontaminate.leaks(docs, benchmark, block_tokens=20)
    assert sorted((r.doc_id, r.item_id) for r in blocked.collect()) == sorted(found)


def test_tiles_take_the_longest_first():
    item, text = list("abcdefghij"), list("fghijxxabcdexxabcdefg")
    pairs = [(i, j) for i in range(len(text) - 2) for j in range(len(item) - 2) if text[i : i + 3] == item[j : j + 3]]
    assert decontaminate.tiles(pairs, 3) == [(2, 7, 3), (14, 0, 7)]


def test_tiles_equal_brute_force():
    chance = random.Random(1)
    for _ in range(400):
        match = chance.randint(1, 4)
        item, text = chance.choices("abc", k=chance.randint(match, 14)), chance.choices("abcd", k=chance.randint(0, 25))
        wanted, in_item, in_text = [], set(), set()
        while True:
            best = None
            for i in range(len(text)):
                for j in range(len(item)):
                    k = 0
                    while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and i + k not in in_text and j + k not in in_item:
                        k += 1
                    if k >= match and (best is None or (-k, i, j) < best):
                        best = (-k, i, j)
            if best is None:
                break
            k, i, j = -best[0], best[1], best[2]
            wanted.append((i, j, k))
            in_item |= set(range(j, j + k))
            in_text |= set(range(i, i + k))
        pairs = [(i, j) for i in range(len(text) - match + 1) for j in range(len(item) - match + 1) if text[i : i + match] == item[j : j + match]]
        assert decontaminate.tiles(pairs, match) == sorted(wanted)


def test_benchmark_rows_of_all_kinds(spark):
    rows = [(1, "one two three", "x"), (None, "zero one two three four", "x"), (7, "夏の海は青い", "x"), (7, "word " * 5000 + "a b c d e f g", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([("s", "two three"), ("r", "a b c d e f"), ("r", "夏の海は"), (None, "word word word word word")], "item_id string, text string")
    found = sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.leaks(docs, benchmark).collect())
    assert found == [("1", "s"), ("7", "None"), ("7", "r"), ("7", "r"), ("None", "s")]
    assert decontaminate.clean(docs, benchmark).count() == 0 and decontaminate.clean(docs, benchmark.where("item_id = 's'")).count() == 2


PAGES = [
    (1, "https://a.example.org/es/x?q#f", "h"), (2, "HTTP://A.Example.ORG/en/1x", None), (3, "http://x.fr.com/fr/1", "p" * 120), (4, "http://com/de/", "p" * 120), (5, None, "p" * 120),
    (6, "no scheme", "é" * 60), (7, "http://bad.example.net/1", "é" * 60), (8, "http://example.org", ""), (None, "ftp://q?x", "p" * 120),
]


def test_urls(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([(7, 0, 1), (8, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: tuple(r)[1:] for r in urls.verdicts(pages, labels).collect()}
    assert rows[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and rows[2] == ("a.example.org", "/en/1x", "example.org/en/1", "block")
    assert rows[3] == ("x.fr.com", "/fr/1", "com/fr/", "allow") and rows[4] == ("com", "/de/", "com/de/", "block")
    assert rows[5] == rows[6] == ("", "", None, "allow") and rows[8] == ("example.org", "", None, "allow") and rows[None][:2] == ("q", "")
    many = spark.range(400).selectExpr("id AS page_id", "concat('http://h', id % 4, '.example.net/') AS url")
    marks = spark.range(400).selectExpr("id AS doc_id", "int(id % 4 <> 1) AS quality", "0 AS toxic")
    assert {r.host for r in urls.verdicts(many, marks).where("verdict = 'block'").collect()} == {"h1.example.net"}
    assert urls.verdicts(pages.limit(0), labels).count() == 0 and urls.verdicts(pages, labels.limit(0)).count() == len(PAGES)


SECRETS = ["token = abcdef", "password: abc", "api_key='A/b+c=9' AKIA" + "A" * 16, "f" * 24 + " " + "e" * 23, "é token:token: abcdefgh", "", None, "-----BEGIN RSA PRIVATE KEY-----", "TOKEN=" + "ab" * 16]


def base_spans(text):
    kinds = (("assign", r"(?a)(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m.group(g)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_secrets_equal_brute_force(spark, empty):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(SECRETS + SECRETS[:2])], "doc_id long, text string, blob string")
    rows = {r.doc_id: r for r in secrets.report(docs).collect()}
    for i, text in enumerate(SECRETS + SECRETS[:2]):
        wanted = base_spans(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest(), text
        assert [s for s in rows[i].spans.split(",") if s.split(":")[0] in secrets.BASE] == wanted
    assert rows[7].spans.startswith("pem:0:") and secrets.report(empty).count() == 0


def test_ledger_scans_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token = abcdef"), (2, "token = abcdef"), (3, "x")], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    assert secrets.scan(docs, path) == 2 and secrets.scan(docs, path) == 0 and secrets.scan(docs, path, "2") == 2
    more = docs.union(spark.createDataFrame([(4, "new")], docs.schema))
    assert secrets.scan(more, path) == 1 and secrets.findings(more, path).where("size(spans) > 0").count() == 2


def test_secrets_of_long_texts(spark):
    """Texts on which plain patterns are quadratic; a private key goes whole."""
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(["Ab+/" * 16] * 3) + "\nAb==\n-----END RSA PRIVATE KEY-----"
    texts = ["http://h:80 " + "a" * 200_000 + " é", "eyJ" * 60_000, "token = abcdef " * 20_000, f"x {key} y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.s for r in docs.select("doc_id", secrets.shown(secrets.spans_of(F.col("text"))).alias("s")).collect()}
    assert spans[0] == "hex:12:200012" and spans[1] == "" and spans[2].count("assign") == 20_000 and spans[2].endswith(f":{15 * 20_000 - 1}")
    out = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert out[2] == "[SECRET] " * 20_000 and out[3] == "x [SECRET] y"
    assert secrets.version_of() != secrets.version_of(secrets.KINDS | secrets.KEY_BODY)


def test_redaction_keeps_all_else(spark):
    docs = spark.createDataFrame([(1, "a token = abcdef z", "s"), (2, "clean", "s"), (3, None, "s")], "doc_id long, text string, source string")
    out = secrets.redact(docs)
    assert out.columns == docs.columns and [r.text for r in out.orderBy("doc_id").collect()] == ["a [SECRET] z", "clean", None]


def test_wavelet_matrix():
    chance = np.random.default_rng(1)
    for n in (0, 1, 7, 3000):
        ids = chance.zipf(1.4, n).astype(np.uint32) % 5000
        matrix = WaveletMatrix(dump(ids))
        assert (matrix.ids() == ids).all()
        for i in range(0, n, 97):
            assert matrix[i] == ids[i]
        for token in {1, 2, 4999, 70000, *ids[:3].tolist()}:
            assert matrix.count(token, n // 3) == (ids[n // 3 :] == token).sum() and (matrix.find(token) == np.flatnonzero(ids == token)).all()


def test_wavelet_select():
    ids = np.random.default_rng(2).integers(0, 300, 30_000).astype(np.uint32)
    matrix = WaveletMatrix(dump(ids))
    for token in (0, 7, 299):
        at = np.flatnonzero(ids == token)
        assert (matrix.find(token) == at).all() and [matrix.select(token, k) for k in (0, 5, len(at) - 1)] == at[[0, 5, -1]].tolist()
    with pytest.raises(IndexError):
        matrix.select(300, 0)


def test_any_tokenizer_is_encoded_whole(tmp_path):
    model = tokenizers.models.WordLevel({"[UNK]": 0, "Ab": 1, "cd": 2}, unk_token="[UNK]")
    other = tokenizers.Tokenizer(model)
    other.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "t.json"))
    assert [x.tolist() for x in tokens.Encoder(str(tmp_path / "t.json"))([b"Ab cd AB", b""])] == [[1, 2, 0], []]


def test_token_shards_round_trip(docs, odd, empty):
    tokenizer = tokenizers.Tokenizer.from_file(registry.WORD_BPE)
    rows, at = {r.doc_id: r for r in tokens.digests(docs, registry.WORD_BPE).collect()}, 0
    for i, text in sorted(ROWS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert tuple(rows[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.digests(odd, registry.WORD_BPE).where("doc_id IS NULL").first().start == 0
    assert tokens.digests(empty, registry.WORD_BPE).count() == 0


def test_shards_hold_special_tokens_as_the_library_has_them(spark):
    tokenizer = tokenizers.Tokenizer.from_file(registry.WORD_BPE)
    texts = ["a <|endoftext|>b", "<|startoftext|><|endoftext|>", "<|endoftext", "x" * 3000 + "<|endoftext|>.", None]
    rows = tokens.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), registry.WORD_BPE).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_encoder_equals_the_library():
    tokenizer = tokenizers.Tokenizer.from_file(registry.WORD_BPE)
    chance = random.Random(3)
    letters = "abcABZ ,.!'’\n\t 012éÉßÿñ×÷œŒ—-<|>T̈́İΣσ日本 \x85\x1c&\"sSdm"
    texts = ["".join(chance.choices(letters, k=chance.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|> a<|startoftext|>B", "don't I'LL we've", ""]
    encode = tokens.Encoder(registry.WORD_BPE)
    assert [x.tolist() for x in encode([t.encode() for t in texts])] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_forgets_what_it_met_once(monkeypatch):
    """Over many runs the pieces met again stay known, the others make room, and the ids are the library's."""
    monkeypatch.setattr(tokens, "CACHE_PIECES", 200)
    monkeypatch.setattr(tokens, "_RUN", 300)
    tokenizer, chance = tokenizers.Tokenizer.from_file(registry.WORD_BPE), random.Random(4)
    encode = tokens.Encoder(registry.WORD_BPE)
    for _ in range(60):
        texts = ["The stra\u00dfe-keeper's 10 \u00c9coles " + "".join(chance.choices("aeinrst\u00e9\u00b2,' ", k=chance.randint(0, 90))) for _ in range(12)]
        assert [x.tolist() for x in encode([t.encode() for t in texts])] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(encode.known) <= 300 and encode.sizes[: len(encode.known)].sum() == encode.filled
        learnt, encode._learn = encode._learn, None
        assert [x.tolist() for x in encode(["\u00e9coles THE stra\u00dfe".encode()])] == [tokenizer.encode("\u00e9coles the stra\u00dfe", add_special_tokens=False).ids]
        encode._learn = learnt


def test_tasks_of_a_process_share_what_it_knows(monkeypatch):
    """Plain pieces are encoded many a call, and one by one to the same ids where zeros have no token; none twice a process."""
    encode, texts = tokens.encoder(registry.WORD_BPE), [b"One stone, \xc3\x84pfel und \xc3\xa7a!", b"", b"10 x0y"]
    ids = [x.tolist() for x in encode(texts)]
    monkeypatch.setattr(tokens.Encoder, "_learn", None)
    assert [x.tolist() for x in tokens.encoder(registry.WORD_BPE)(texts)] == ids
    monkeypatch.undo()
    monkeypatch.setattr(tokens, "_listing", lambda path: None)
    assert [x.tolist() for x in tokens.Encoder(registry.WORD_BPE)(texts)] == ids


def graded(n=600, seed=2):
    chance, rows, labels = random.Random(seed), [], []
    good = ["river", "stone", "cloud", "meadow", "walks", "slowly", "under", "bright", "skies", "and", "the", "of"] + [f"word{k}" for k in range(200)]
    for i in range(n):
        words = chance.choices(good, k=80)
        kind = i % 5
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words[10] = "scum"
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


def test_ordinal_grades_held_out(spark):
    """2,000 labelled rows, 400 held out; a few hundred rows are too few against 200 words of noise."""
    rows, labels = graded(2400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ordinal.train(docs.where("doc_id < 2000"), marks)
    assert model.thresholds[0] < model.thresholds[1]
    found = {r.doc_id: r for r in ordinal.score(docs, model).collect()}
    right = sum((found[i].p_at_least_2 >= 0.5) == (i % 5 > 1) for i in range(2000, 2400))
    assert right >= 360 and all(r.p_at_least_1 >= r.p_at_least_2 for r in found.values())


def test_ordinal_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ordinal.select(docs, labels).where("kept").count() == len(ROWS) and ordinal.select(empty, labels).count() == 0


def test_rule_statistics():
    chance = random.Random(4)
    for _ in range(300):
        text = "".join(chance.choices(["a", "b", "aa", " ", "  ", "\n", "\t", "#", "é", "|"], k=chance.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts, covered = Counter(triples), set()
        for i, t in enumerate(triples):
            covered |= {i, i + 1, i + 2} if counts[t] > 1 else set()
        lines = text.split("\n")
        repeated = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
        assert rules.statistics(text)[:5] == (len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text), repeated, len(covered))


def test_trees_learn_and_stay_monotone():
    chance = np.random.default_rng(3)
    x = chance.random((2000, 3))
    y = (chance.random(2000) < 1 / (1 + np.exp(6 * (x[:, 0] - 0.5) - 3 * (x[:, 1] > 0.7)))).astype(float)
    model = rules.fit(x, y, np.array([-1, 0, 0]))
    grid = np.repeat(chance.random((50, 1, 3)), 40, axis=1)
    grid[:, :, 0] = np.linspace(0, 1, 40)
    scores = model.margin(grid.reshape(-1, 3)).reshape(50, 40)
    assert (np.diff(scores, axis=1) <= 1e-9).all()
    assert ((model.margin(x) > 0) == (y > 0)).mean() > 0.75


def test_trees_equal_a_plain_walk():
    chance = np.random.default_rng(5)
    x = chance.random((400, 3))
    model = rules.fit(x, (x[:, 0] + x[:, 2] > 1).astype(float), np.array([0, 0, 1]), trees=8)
    for row, margin in zip(x, model.margin(x), strict=True):
        total = model.base
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] + (row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        assert abs(total - margin) < 1e-9


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    good, labels = graded()[0][2][1], spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, good), (1, "short"), (None, good), (None, "short"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in rules.keep(docs, labels).collect()) == [("1", good), ("None", good)]
    assert sorted(str(r.doc_id) for r in simhash.first_of_each(docs).collect()) == ["1", "1", "None"]


def test_ordinal_fit_is_near_the_best_of_its_likelihood():
    """Against a climb by coordinates over the penalised likelihood, written out, of two features and two thresholds."""
    draw, n, prior = np.random.default_rng(3), 400, 3.0
    features = [(np.array([7, 9]), draw.normal(size=2)) for _ in range(n)]
    x = np.array([v for _, v in features])
    grades = np.digitize(x @ [1.5, -0.8] + draw.logistic(size=n), [-0.7, 0.9])
    logistic = lambda z: 1 / (1 + np.exp(-z))

    def loss(p):
        cuts = np.array([-np.inf, p[2], p[3], np.inf])
        if p[3] <= p[2]:
            return np.inf
        f = x @ p[:2]
        share = logistic(cuts[grades + 1] - f) - logistic(cuts[grades] - f)
        return -np.log(np.maximum(share, 1e-12)).mean() + prior / n / 2 * (p[:2] ** 2).sum()

    best, step = np.array([0.0, 0.0, -1.0, 1.0]), 0.5
    while step > 1e-4:
        tries = [best + step * sign * np.eye(4)[i] for i in range(4) for sign in (-1, 1)]
        found = min(tries, key=loss)
        best, step = (found, step) if loss(found) < loss(best) else (best, step / 2)
    with np.errstate(over="ignore"):
        model = ordinal.fit(features, grades, prior=prior)
    made = np.array([model.weights[7], model.weights[9], *model.thresholds])
    assert loss(made) < loss(best) + 0.005 and np.abs(made - best).max() < 0.2


def test_ordinal_scores_equal_a_plain_sum(spark):
    model = ordinal.Model(np.random.default_rng(8).normal(size=ordinal.SPACE).astype(np.float32), np.array([-0.5, 0.7]))
    text = "Some words, SOME words!! 123 the end"
    values, _ = ordinal.text_features(text, ordinal._Tokens(ordinal.token_features))
    f = sum(float(model.weights[k]) * v for k, v in values.items())
    row = ordinal.score(spark.createDataFrame([(1, text), (None, None)], "doc_id long, text string"), model).where("doc_id = 1").first()
    tails = [1 / (1 + np.exp(-(f - t))) for t in model.thresholds]
    assert np.allclose([row.p_at_least_1, row.p_at_least_2, row.expected_grade], [*tails, sum(tails)])


def test_rules_keep_good_and_drop_bad(spark, docs, empty):
    rows, labels = graded()
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, kept string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in rules.keep(df, marks).collect()}
    assert sum(i in kept for i, _ in rows if i % 5) >= 0.98 * 480 and not any(i in kept for i, _ in rows if i % 5 == 0)
    assert rules.keep(df, marks).columns == df.columns
    assert rules.verdicts(empty, marks).count() == 0
    none = rules.verdicts(docs, marks.limit(0)).collect()
    assert len(none) == len(ROWS) and all(r.kept != r.base_failed for r in none)


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    rows = {r.page_id: r for r in warc.digests(pages).collect()}
    assert len(rows) == len(PAGES)
    firsts = {"p" * 120: 3, "é" * 60: 6}
    for page, _, html in PAGES:
        payload, first = (html or "").encode(), firsts.get(html)
        again = first if first != page else None
        assert tuple(rows[page]) == (page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", again)
    folder = str(tmp_path / "warc")
    warc.archive(pages, folder)
    back = spark.read.format("warc").load(folder)
    assert {r.target_uri for r in back.collect()} == {p[1] for p in PAGES}
    assert back.where("record_type = 'revisit'").count() == 4 and back.where("target_uri LIKE 'http://x%'").count() == 1
    assert spark.read.format("warc").option("payload", "false").load(folder).where("payload IS NOT NULL").count() == 0
    assert warc.digests(pages.limit(0)).count() == 0


def test_warc_members_are_gzip(tmp_path):
    import gzip

    row = {"record_id": "urn:page:1", "record_type": "response", "target_uri": "http://a/\r\nX: 50%", "date": None, "digest": "d", "refers_to": None, "payload_bytes": 9000, "payload": b"x" * 9000}
    data = warc.record(row) + warc.record({**row, "record_type": "revisit", "payload": None})
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    found = list(warc.records(memoryview(data), lambda r: True, True))
    assert [r["target_uri"] for r in found] == [row["target_uri"]] * 2 and found[0]["payload"] == row["payload"] and found[1]["payload"] is None


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, 42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_equals_brute_force(spark, docs, odd, empty):
    prints, root = {i: brute_print(t) for i, t in ROWS}, {i: i for i, _ in ROWS}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 2 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert rows == {i: (f"{prints[i]:016x}", find(i)) for i in prints}
    assert {r.component_id for r in simhash.near_duplicates(odd).where("doc_id = 5 OR doc_id IS NULL").collect()} == {5}
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.first_of_each(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {find(i) for i in prints}
    assert simhash.first_of_each(odd).where("doc_id = 5").count() == 1


def test_ball_links_and_chains(spark):
    values = [0, 1, 3, 7, 1 << 63, 255 << 20, (255 << 20) ^ 5]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    pairs = {tuple(sorted((r.a, r.b))) for r in simhash.links(prints).collect()}
    wanted = {tuple(sorted((a, b))) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert pairs == wanted
    roots = {r.node: r.root for r in simhash.components(simhash.star_links(prints)).collect()}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} <= {0} and len(set(roots.values())) == 2


def test_byte_bpe_equals_the_library(docs, odd, empty):
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(registry.TIKTOKEN), special_tokens={})
    for block in (50, 1 << 20):
        rows = {r.doc_id: r for r in bpe.encode(docs, registry.TIKTOKEN, public_tokenizers.PATTERN, block_bytes=block, buckets=3).collect()}
        assert {i: rows[i].ids for i, _ in ROWS} == {i: encoder.encode_ordinary(t or "") for i, t in ROWS}
    found = {r.doc_id: r for r in bpe.digests(docs, registry.TIKTOKEN, public_tokenizers.PATTERN).collect()}
    for i, text in ROWS:
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and found[i].n_tokens == len(rows[i].ids)
    assert bpe.digests(odd, registry.TIKTOKEN, public_tokenizers.PATTERN).count() == 4
    assert bpe.digests(empty, registry.TIKTOKEN, public_tokenizers.PATTERN).count() == 0


def test_keys_written_as_escapes_go_with_their_bodies(spark):
    """A service account's JSON: line ends are two characters each."""
    body = "\\n".join("MIIEvQ" + c * 58 for c in "ABCDE")
    for gap, text in (("n", body), ("rn", body.replace("\\n", "\\r\\n")), ("slashes", body.replace("C", "\\/"))):
        key = f'{{"private_key": "-----BEGIN PRIVATE KEY-----\\n{text}\\n-----END PRIVATE KEY-----\\n", "kind": "a"}}'
        headed = f"-----BEGIN RSA PRIVATE KEY-----\\nProc-Type: 4,ENCRYPTED\\nDEK-Info: AES,00\\n\\n{text}\\n-----END RSA PRIVATE KEY-----"
        cut = f"-----BEGIN PRIVATE KEY-----\\n{text}"
        out = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame([(1, key), (2, headed), (3, cut)], "doc_id long, text string")).collect()}
        assert out == {1: '{"private_key": "[SECRET]\\n", "kind": "a"}', 2: "[SECRET]", 3: "[SECRET]"}, gap


def test_secret_query_scans_only_what_is_new(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 15} token = abcdefgh{i % 15}") for i in range(20)] + [(None, "x")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    path = str(tmp_path / "ledger")
    assert secrets.scan(secrets.earlier(docs, 0.5), path) == 10 and secrets.scan(docs, path) == 6
    rows = registry.op4_secret_ledger(spark, str(tmp_path)).collect()
    assert len(rows) == 21 and sum(r.n_assign for r in rows) == 20
    assert secrets.earlier(docs.limit(0)).count() == 0


def _url_tables(spark, duck, tmp_path, pages, labels):
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("pages", "labels"):
        duck.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")


def test_url_levels_of_hosts_that_labels_do_not_have(spark, tmp_path):
    """Hosts under suffixes that no labelled host has, with users, ports and addresses: query against SQL."""
    import duckdb

    bad = [(i, f"http://h{i}.uk/a") for i in range(7)]
    good = [(i, f"https://g{i}.com/b") for i in range(7, 14)]
    odd = ["http://new.co.uk/a", "http://h3.co.uk", "http://a.h1.uk", "http://me:pw@h2.uk:8080/x?y", "http://192.0.2.7/", "http://10.0.0.1:80", "http://com", "http://co.uk/", "//none", None, "http://x.gov.uk/", "http://g8.com:443#f"]
    pages, labels = bad + good + [(100 + i, url) for i, url in enumerate(odd)], [(i, int(i >= 7), 0) for i in range(14)]
    duck = duckdb.connect()
    _url_tables(spark, duck, tmp_path, pages, labels)
    want = {row[0]: row[1:] for row in duck.sql(urls.sql()).fetchall()}
    rows, marks = spark.read.parquet(f"{tmp_path}/pages.parquet"), urls.outcomes(spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(rows, marks).collect()}
    assert got == want and got[100][3] == "allow" and got[102][3] == "block"
    table = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("gov.uk",)], "suffix string")
    listed = {r.page_id: r.verdict for r in urls.judge(rows, marks, suffixes=table).collect()}
    assert listed[100] == listed[110] == "allow" and listed[102] == "block" and all(listed[i] == "block" for i in range(7))
