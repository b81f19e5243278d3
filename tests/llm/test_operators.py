"""The ten operators against brute force, round trips and held-out accuracy, and on degenerate tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandmill.llm import chat, decontaminate, language_model, media, mixing, near_dedup, pii, quality, queries, secrets, shared, text_arrays, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row_key string, node string, held_out string, part string"
LONG = "lorem ipsum " * 40_000 + "X" * 50_000


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def held(doc_id, folds, fold):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, ties, repeated rows and clashing extra columns."""
    texts = [None, "", " \t\n", "one", "Über ÉTÉ été  x y", LONG, "a b c d e f", "a b c d e f", "A B\tC D\nE F", "the same row", "the same row", "e@x.org token=abcdefghijkl 1.2.3.4"]
    rows = [(i if i != 3 else None, t, "en", None if i % 4 == 0 else f"s{i % 3}", 0, 1.0, "k", "n", "h", "p") for i, t in enumerate(texts)]
    rows.append(rows[10])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


# Tokenising -----------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    rng = random.Random(1)
    alphabet = "abAB \t\n\x0b\x0c\réü 漢.,"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "x" * 600_000 + " y"]
    buf, offsets = text_arrays.text_buffer(pa.array(texts))
    start, end, first = text_arrays.words(buf, offsets)
    hashes = text_arrays.word_hashes(buf, start, end)
    known = {}
    for i, text in enumerate(texts):
        expected = [w.encode() for w in words(text)]
        got = [bytes(buf[a:b]).lower() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])]
        assert got == expected
        for w, h in zip(got, hashes[first[i] : first[i + 1]].tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_sliced_columns():
    column = pa.array(["skip", "a b", None, "c"]).slice(1)
    buf, offsets = text_arrays.text_buffer(column)
    assert bytes(buf) == b"a bc" and offsets.tolist() == [0, 3, 3, 4]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)]
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["comp"] for r in shared.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for p in pairs if p[0] != p[1] for n in p}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_shuffled_path(spark, monkeypatch):
    ids = random.Random(7).sample(range(1 << 62), 3000)
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    rounds, keep = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, name: rounds.append(name) or keep(df, name))
    got = shared.components(links).collect()
    assert len(got) == 3000 and {r["comp"] for r in got} == {min(ids)}
    assert rounds.count("labels") <= 30


# Classifiers ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.9), (toxicity, "toxic", 0.85)])
def test_classifiers(spark, docs, labels, odd, empty, module, label, least):
    model = module.train(docs, labels)
    scored = module.score(docs, model)
    assert scored.count() == docs.count()
    assert scored.where("score NOT BETWEEN 0 AND 1 OR isnan(score)").count() == 0
    assert scored.where(scored.held_out != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)).count() == 0
    right = scored.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert right >= least
    few = module.score(odd, model).toPandas()
    assert len(few) == 13 and few["score"].notna().all()
    assert few[few.doc_id == 6].score.iloc[0] == few[few.doc_id == 7].score.iloc[0]
    assert module.score(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.score(odd, module.train(odd, none)).select("score").distinct().count() == 1
    single = spark.createDataFrame([(i, 1, 1) for i in (0, 2, 4, 5, 6)] + [(None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    assert module.score(odd, module.train(odd, single)).where("score > 0.5").count() == 13


def test_toxic_rows_are_rejected(spark, docs, labels):
    model = toxicity.train(docs, labels)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in toxicity.score(docs, model).where("predicted = 0").select("doc_id").collect()}


def plain_trees(x, y, trees, depth, bins, rate=0.1, ridge=1.0, least=2.0):
    """The same boosting by loops over rows, nodes, features and cuts; the margins of the training rows."""
    margin = [math.log(y.mean() / (1 - y.mean()))] * len(y)
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32).tolist())) for f in range(x.shape[1])]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        groups = [list(range(len(y)))]
        for _ in range(depth):
            following = []
            for rows in groups:
                total = (sum(grad[i] for i in rows), sum(hess[i] for i in rows))
                best, choice = 1e-9, None
                for f, own in enumerate(cuts):
                    for c in own:
                        left = [i for i in rows if x[i, f] <= c]
                        g, h = sum(grad[i] for i in left), sum(hess[i] for i in left)
                        if h < least or total[1] - h < least:
                            continue
                        gain = g * g / (h + ridge) + (total[0] - g) ** 2 / (total[1] - h + ridge) - total[0] ** 2 / (total[1] + ridge)
                        if gain > best + 1e-12:
                            best, choice = gain, (f, c)
                go = (lambda i: x[i, choice[0]] <= choice[1]) if choice else (lambda i: True)
                following += [[i for i in rows if go(i)], [i for i in rows if not go(i)]]
            groups = following
        for rows in groups:
            step = -rate * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + ridge)
            for i in rows:
                margin[i] += step
    return np.array(margin)


def test_trees_against_plain_loops():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 4)).astype(np.float32)
    y = ((x[:, 0] + x[:, 2] > 0.2) ^ (rng.random(160) < 0.1)).astype(float)
    model = quality.fit(x, y, trees=6, depth=3, bins=8)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-plain_trees(x, y, 6, 3, 8))), atol=1e-9)


def test_statistics_against_plain_counts(docs):
    texts = [r["text"] for r in docs.limit(60).collect()] + [None, "", "a", "One TWO two\n\ntwo 33"]
    got = quality.statistics(pa.array(texts))
    for row, text in zip(got, texts):
        w, raw = words(text), (text or "").encode()
        if not raw:
            assert not row.any()
            continue
        n, pairs = max(len(w), 1), set(zip(w, w[1:]))
        lines = [x for x in (text or "").split("\n") if x]
        expected = {0: math.log1p(len(w)), 1: math.log1p(len(raw)), 2: np.mean([len(x.encode()) for x in w]) if w else 0, 5: sum(65 <= b <= 90 for b in raw) / len(raw), 14: len(set(w)) / n, 15: max(Counter(w).values(), default=0) / n, 16: (len(pairs) if len(w) > 1 else 1) / max(n - 1, 1), 17: 1 - len(set(lines)) / max(len(lines), 1)}
        for k, value in expected.items():
            assert row[k] == pytest.approx(value, rel=1e-5, abs=1e-6), (k, text[:40])


def test_trees_learn_a_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == (y[1500:] == 1)).mean() > 0.95


def test_toxicity_long_texts_are_read_whole():
    seen = np.zeros(1 << toxicity.BITS, np.uint8)
    filler = np.frombuffer(b"plain words here " * 40_000, np.uint8)
    toxicity.present(np.concatenate([filler, np.frombuffer(b" zebra", np.uint8)]), seen)
    alone = np.zeros_like(seen)
    toxicity.present(np.frombuffer(b"zebra", np.uint8), alone)
    assert (seen >= alone).all() and alone.any()


def test_toxicity_windows_change_no_ngram(monkeypatch):
    rng = random.Random(4)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abCé\t") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 60))).encode()
        marks = []
        for piece in (1 << 18, 16, 1):
            monkeypatch.setattr(toxicity, "PIECE", piece)
            marks.append(np.zeros(1 << toxicity.BITS, np.uint8))
            toxicity.present(np.frombuffer(text, np.uint8), marks[-1])
        assert (marks[0] == marks[1]).all() and (marks[0] == marks[2]).all()


def brute_ngrams(text):
    """Every run of 4 to 6 bytes of the framed text without a space inside, by the hash of its bytes."""
    framed = " " + re.sub("[\t\n\x0b\x0c\r]", " ", text.translate(LOWER)) + " "
    data, out = framed.encode(), set()
    for n in (4, 5, 6):
        for at in range(len(data) - n + 1):
            gram = data[at : at + n]
            if b" " not in gram[1:-1]:
                out.add((int.from_bytes(gram, "big") * int(toxicity._MULT[n]) % (1 << 64)) >> (64 - toxicity.BITS))
    return out


def test_toxicity_against_brute_force(spark):
    """N-grams, ratios and the logistic fit by plain loops."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        toxic = i % 3 == 0
        pool = ["awful", "stupid", "hate"] if toxic else ["kind", "garden", "music"]
        rows.append((i, " ".join(rng.choice([*pool, "the", "house", "Öl"]) for _ in range(12)), int(toxic)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    used = [(brute_ngrams(t), y) for i, t, y in rows if not held(i, 3, 1)]
    positive, negative = sum(y for _, y in used), sum(1 - y for _, y in used)
    toxic, other = (Counter(g for grams, y in used if y == side for g in grams) for side in (1, 0))
    ratio = {g: math.log((toxic[g] + 1) / (positive + 2)) - math.log((other[g] + 1) / (negative + 2)) for g in {*toxic, *other} if toxic[g] + other[g] >= 5}
    ratio = {g: r for g, r in ratio.items() if abs(r) >= 1}
    names = sorted(ratio)
    x = np.array([[ratio[g] * (g in grams) for g in names] for grams, _ in used])
    y = np.array([y for _, y in used])
    w, b = np.zeros(len(names)), math.log(positive / negative)
    for _ in range(4000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= 0.02 * (x.T @ (p - y) / len(y) + 1e-3 * w)
        b -= 0.02 * float((p - y).mean())
    model = toxicity.train(docs, labels)
    assert set(np.flatnonzero(model.weights)) <= set(names)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    margin = {i: sum(w[names.index(g)] * ratio[g] for g in brute_ngrams(t) if g in ratio) + b for i, t, _ in rows}
    assert all((got[i] > 0.5) == (margin[i] > 0) for i, _, _ in rows)
    assert np.corrcoef([margin[i] for i in got], [math.log(got[i] / (1 - got[i])) for i in got])[0, 1] > 0.97


# Media ----------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, docs, odd, empty):
    for table in (docs.select("doc_id", "text"), odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        got = media.text_media(table).drop("position").collect()
        expected = Counter()
        for doc_id, text in rows:
            raw = (text or "").encode()
            payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
            stored = media.encode(payload)
            assert media.decode(stored) == payload
            expected[(doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(payload))] += 1
        assert Counter(tuple(r) for r in got) == expected
    assert media.text_media(empty).count() == 0


def test_unclosed_and_nested_tags_lose_no_text():
    said = lambda html: [(p["kind"], p["text"] or p["reference"], p["caption"]) for p in media.sequence_of(html)]
    assert said('<figure><figcaption>First</figcaption><img src="a"></figure>after') == [("media", "a", "First"), ("text", "after", None)]
    assert said('<figure><img src="a"><figcaption>Open</figure><p>rest</p>') == [("media", "a", "Open"), ("text", "rest", None)]
    assert said("<figcaption>Lone<p>rest</p>") == [("text", "Lone", None), ("text", "rest", None)]
    assert said('<figure><img src="a"><figcaption>never closed') == [("media", "a", "never closed")]
    assert said("<noscript>open <p>all the rest</p>") == [("text", "open", None), ("text", "all the rest", None)]
    assert said('<noscript><img src="x">gone</noscript>kept') == [("text", "kept", None)]
    assert said('<figure><img src="a"><figure><img src="b"><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>') == [("media", "a", "outer"), ("media", "b", "inner")]
    assert said("<table><tr><td>a</td><td>b</td></tr></table>") == [("text", "a b", None)]
    assert said('<img srcset="big.png 2x, small.png 1x"><img data-src="lazy"><video poster="p"></video><object data="o"></object>') == [("media", x, None) for x in ("big.png", "lazy", "p", "o")]
    assert said("<figure><figcaption>no media</figcaption></figure>") == [("text", "no media", None)]
    assert said("<script>var a = '<p>';") == []


def test_media_damage_is_noticed():
    stored = bytearray(media.encode(b" " * 192))
    stored[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode(bytes(stored))


def test_sequences_keep_order_and_captions(spark):
    html = '<html><head><style>p{}</style></head><body><p>Before &amp; <b>bold</b></p><figure><img src="sha256:ab" alt="alt"><figcaption>The  caption</figcaption></figure><p>Between</p><img src="x.png" alt="only alt"><script>no()</script>After'
    parts = media.sequence_of(html)
    assert [(p["position"], p["kind"], p["text"], p["reference"], p["caption"]) for p in parts] == [
        (0, "text", "Before & bold", None, None), (1, "media", None, "sha256:ab", "The caption"), (2, "text", "Between", None, None), (3, "media", None, "x.png", "only alt"), (4, "text", "After", None, None),
    ]
    assert media.sequence_of(None) == []
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    facts = media.media_facts(spark.createDataFrame([], "digest binary, media binary"))
    rows = media.resolve(media.interleave(pages), facts).orderBy("position").collect()
    assert [r["position"] for r in rows] == [0, 1, 2, 3, 4] and all(r["media_bytes"] is None for r in rows)


# Mixing ---------------------------------------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def check_mix(rows, texts):
    sizes = Counter()
    for doc_id, source, size, source_size, target, taken in rows:
        sizes[source] += size
    goal = water(dict(sizes))
    taken_by = Counter()
    for doc_id, source, size, source_size, target, taken in rows:
        assert source_size == sizes[source] and target == pytest.approx(goal[source])
        assert 0 <= taken <= 3 * size
        taken_by[source] += taken
    for s in sizes:
        assert abs(taken_by[s] - goal[s]) <= 1 + 1e-6 * goal[s]
    assert Counter((d, s) for d, _, s, *_ in rows) == Counter((d, len(words(t))) for d, t in texts)


def test_mixing(spark, docs, odd, empty):
    for table in (docs, odd):
        out = mixing.mix(table).select("doc_id", "source", "size", "source_size", "target", "taken")
        rows = [tuple(r) for r in out.collect()]
        check_mix(rows, [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()])
        again = mixing.mix(table.repartition(3)).select("doc_id", "source", "size", "source_size", "target", "taken")
        assert Counter(tuple(r) for r in again.collect()) == Counter(rows)
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]


# Secrets --------------------------------------------------------------------------------------------------------------

NAIVE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 16),
)


def naive_secrets(text):
    found = sorted((m.start(), i, m.end(), kind) for i, (kind, rx, ok) in enumerate(NAIVE) for m in rx.finditer(text or "") if ok(m))
    return [f"{k}:{s}:{e}" for s, _, e, k in found]


def test_secret_spans(spark, docs, odd, empty):
    rng = random.Random(7)
    pieces = ["token", "TOKEN", "=", ": ", "'", '"', "password", "secret", "Api_Key", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", " ", "x", "abcdefghijkl", "ſecret", "\n", "toKen"]
    fuzz = spark.createDataFrame([(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(30))), "s") for i in range(1500)], "doc_id long, text string, source string")
    for table in (docs, odd, fuzz):
        texts = Counter((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
        got = Counter()
        for r in secrets.scan(table).collect():
            base = [s for s in r["spans"].split(",") if s and not s.startswith("token")]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b.startswith(k + ":") for b in base) for k in ("assign", "access", "hex"))
            got[(r["doc_id"], ",".join(base))] += 1
        expected = Counter()
        for (doc_id, text), n in texts.items():
            expected[(doc_id, ",".join(naive_secrets(text)))] += n
        assert got == expected
    assert secrets.scan(empty).count() == 0


def test_ownership_separates_copies_from_live_values(spark):
    live, copied = "Zq9xK2mW7rT4bV8nL3cP", "Hk5dJ8sQ1wE6yU0aG2zX"
    rows = [(1, f"key {live} here", "a"), (2, f"again {live}", "a"), (3, f"use {copied}", "a"), (4, f"use {copied}", "b"), (5, f"use {copied}", None)]
    out = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1]["spans"] == f"token:4:{4 + len(live)}" and out[1]["n_live"] == 1
    assert out[3]["spans"] == "" and out[3]["n_copied"] == 1 and out[5]["n_copied"] == 1


def test_one_owner_with_many_repositories_is_a_copy(spark):
    value = "Zq9xK2mW7rT4bV8nL3cP"
    rows = [(i, f"use {value}", "a") for i in range(50)] + [(99, "token=abcdefghijkl", "a")]
    out = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0]["spans"] == "" and out[0]["n_live"] == 0 and out[0]["verdicts"] == f"token:4:{4 + len(value)}:copied:1:50"
    assert out[99]["verdicts"] == "assign:0:18:live:1:1" and out[99]["spans"] == "assign:0:18"


# Personal data --------------------------------------------------------------------------------------------------------


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda v: 13 <= sum(c.isdigit() for c in v) <= 19 and luhn(v)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
)


def naive_pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rx, ok in BASE for m in rx.finditer(text or "") if ok(m.group())]


def test_pii_spans(spark, docs, odd, empty):
    rng = random.Random(9)
    pieces = ["a", "x.y", "@", "b", ".", "..", "_", "-", " ", "1", "255", "256", "0009", "+", "4111 1111 1111 1111", "4111111111111111", "é", "😀", "(030)", "+49 30 1234567", "12-34", "\n"]
    fuzz = spark.createDataFrame([(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))) for i in range(1500)], "doc_id long, text string")
    for table in (docs.select("doc_id", "text"), odd, fuzz):
        expected = Counter((r["doc_id"], hashlib.sha256(",".join(naive_pii(r["text"])).encode()).hexdigest()) for r in table.select("doc_id", "text").collect())
        rows = pii.digests(table).collect()
        assert Counter((r["doc_id"], r["base_sha256"]) for r in rows) == expected
        for r in rows:
            base = [s for s in r["spans"].split(",") if s and s.split(":")[0] in pii.KINDS[:4]]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(b.startswith(k + ":") for b in base) for k in pii.KINDS[:4])
    assert pii.digests(empty).count() == 0


def test_pii_adds_spans_and_redacts(spark, odd):
    text = "mail me: joe [at] site [dot] com or call 555-123-4567; é ssn 123-45-6789, or a@b.org."
    table = spark.createDataFrame([(1, text, "extra", 5), (2, None, "x", 6), (3, "clean text", "y", 7), (3, "clean text", "y", 7)], "doc_id long, text string, _spans string, _KEY int")
    spans = next(r["spans"] for r in pii.digests(table).collect() if r["doc_id"] == 1)
    assert spans.startswith("email:") and "mail_spelt:9:" in spans and "phone_local:" in spans and "ssn:" in spans
    out = [tuple(r) for r in pii.redact(table).orderBy("doc_id").collect()]
    assert out[0][1] == "mail me: <MAIL_SPELT> or call <PHONE_LOCAL>; é ssn <SSN>, or <EMAIL>."
    assert out[0][2:] == ("extra", 5) and out[1:] == [(2, None, "x", 6), (3, "clean text", "y", 7), (3, "clean text", "y", 7)]
    assert pii.redact(odd).count() == odd.count() and pii.redact(odd).columns == odd.columns


def test_pii_plan_is_native(docs):
    plan = pii.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# Chat -----------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark, data, duck):
    turns = [(1, 1, "user", "b"), (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nno &lt;| &amp; <|"), (1, 2, "assistant", "x<|im_turn|>"), (1, 3, "assistant", None), (2, 0, None, ""), (2, 0, "ro\nle&nl;", "é😀"), (2, 0, "ro\nle&nl;", "é😀"), (None, None, "assistant", "end"), (3, 0, "assistant", ""), (4, 0, "user", "&" * 5000)]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, parts int")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chats(table)).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        whole = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        learned = "".join(x or "" for _, _, r, x in own if r == "assistant")
        r = out[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    text = next(r["formatted"] for r in chat.format_chats(table).collect() if r["conv_id"] == 1)
    assert text.count("<|im_start|>") == 2 and text.count("<|im_turn|>") == 2 and len(text) == out[1]["formatted_chars"]
    assert chat.digests(chat.format_chats(table.limit(0))).count() == 0
    plan = queries.op6_chat_format(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# Decontamination ------------------------------------------------------------------------------------------------------


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_recall(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(60)]
    docs, truth = [], []
    for n in range(400):
        k = rng.randrange(60)
        part = list(items[k])
        for _ in range(rng.randint(0, decontaminate.edits(len(part), 0.8))):
            i = rng.randrange(len(part))
            move = rng.randrange(3)
            if move == 0:
                part[i] = rng.choice(vocabulary)
            elif move == 1:
                del part[i]
            else:
                part.insert(i, rng.choice(vocabulary))
        pad = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        docs.append((n, " ".join([*pad(), *part, *pad()]).upper().replace(" ", ", ", 5)))
        truth.append(k)
    docs += [(1000 + n, " ".join(rng.choice(vocabulary) for _ in range(200))) for n in range(200)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_items(table, bench).collect()}
    assert sum((n, k) in got for n, k in enumerate(truth)) >= 0.99 * len(truth)
    assert not any(d >= 1000 for d, _ in got)
    for (n, k), d in list(got.items())[:60]:
        assert d == edit_distance(items[k], docs[n][1].lower().replace(",", "").split())
    kept = {r["doc_id"] for r in decontaminate.remove(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (5, "one")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_items(odd, bench).collect())
    assert got == Counter({(d, i): 1 for d in (6, 7, 8) for i in (1, 4)} | {(None, 5): 1})
    assert decontaminate.find_items(empty, bench).count() == 0
    assert decontaminate.remove(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.remove(odd, bench).columns == odd.columns


def test_plan_does_not_follow_the_benchmark(spark):
    bench = lambda n: spark.createDataFrame([(i, f"p{i} q{i} r{i} s{i} t{i} u{i}") for i in range(n)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x p{i} q{i} r{i} s{i} t{i} u{i} y") for i in range(5)], "doc_id long, text string")
    assert {(r[0], r[1]) for r in decontaminate.find_items(docs, bench(5)).collect()} == {(i, i) for i in range(5)}
    plans = [decontaminate.find_items(docs, bench(n))._jdf.queryExecution().optimizedPlan().toString() for n in (5, 3000)]
    assert plans[0].count("MapInArrow") == plans[1].count("MapInArrow") == 1


def exhaustive(items, texts, similarity=0.8):
    """Every item against every text by plain dynamic programming."""
    return {(d, k) for d, text in texts for k, item in enumerate(items) if edit_distance(item, text) <= decontaminate.edits(len(item), similarity)}


def test_decontamination_against_exhaustive_search(spark):
    """All edits that are allowed are used; long items are cut into pieces; a small vocabulary makes chance likenesses."""
    rng = random.Random(11)
    vocabulary = [f"w{int(rng.expovariate(1 / 80))}" for _ in range(2000)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 6, 9, 10, 15, 20, 31, 33, 50, 90, 200) for _ in range(2)]
    texts = []
    for n in range(240):
        part = list(items[n % len(items)])
        for _ in range(decontaminate.edits(len(part), 0.8)):
            i, move = rng.randrange(len(part)), rng.randrange(3)
            part[i : i + (move < 2)] = [] if move == 0 else [rng.choice(vocabulary)]
        texts.append((n, [rng.choice(vocabulary) for _ in range(rng.randrange(30))] + part + [rng.choice(vocabulary) for _ in range(rng.randrange(30))]))
    truth = exhaustive(items, texts)
    table = spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(table, bench).collect()}
    assert got <= truth and len(truth) >= 200
    assert len(got) >= 0.98 * len(truth)


def test_templated_benchmark(spark):
    """Thousands of items with one opening, and texts with that opening."""
    opening = "which of the following statements about"
    bench = spark.createDataFrame([(i, f"{opening} " + " ".join(f"k{i}x{j}" for j in range(14))) for i in range(5000)], "item_id long, text string")
    texts = [(i, f"{opening} something else altogether that is in no list of questions anywhere " * 3) for i in range(40)]
    texts += [(100 + i, f"see: {opening} " + " ".join(f"k{i}x{j}" for j in range(14))) for i in range(5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r[0], r[1]) for r in decontaminate.find_items(docs, bench).collect()} == {(100 + i, i) for i in range(5)}


# Near duplicates ------------------------------------------------------------------------------------------------------


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows))


def near_group(rng, n):
    base = [f"v{rng.randrange(400)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(400)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [1000, 7])
def test_near_duplicates(spark, docs, odd, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(3)
    group = spark.createDataFrame(list(enumerate(near_group(rng, 150) + ["copy of one text"] * 60)), "doc_id long, text string")
    for table, width in ((docs.select("doc_id", "text"), 2), (odd, 2), (group, 2), (group, 5)):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        got = near_dedup.near_duplicates(table, width=width).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, width, 80)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_without_ids(spark):
    """A row without an id is kept only where no row of its component has one."""
    text, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(200))
    table = spark.createDataFrame([(1, text), (None, text), (None, text + " x"), (None, other), (None, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table).collect())
    assert got == Counter({(1, 1, True): 1, (None, 1, False): 2, (None, None, True): 2})


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sketch_bound_never_rules_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, max(1, n // 12)).astype(np.uint64)]))
        if len(b) and near_dedup.links(a, b, 80):
            assert near_dedup.may_link(near_dedup.sketch(a), len(a), near_dedup.sketch(b), len(b), 80)


# Language model -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk,fan", [(1 << 17, 8), (1 << 13, 2)])
def test_language_model(spark, docs, odd, empty, monkeypatch, chunk, fan):
    """One level of messages, and (with small chunks and a fan of 4) four."""
    monkeypatch.setattr(language_model, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(language_model, "FAN_BITS", fan)
    for table in (docs.select("doc_id", "text").where(f"doc_id < {chunk >> 8}"), odd):
        rows = [(r["doc_id"], [*words(r["text"]), "\0end"]) for r in table.select("doc_id", "text").collect()]
        counts = Counter(w for d, ws in rows if not held(d, 7, 2) for w in ws)
        total, kinds = sum(counts.values()), len(counts)
        expected = Counter((d, held(d, 7, 2), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 4)) for d, ws in rows)
        got = language_model.score(table).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language_model.score(empty).count() == 0


def test_language_model_beats_its_base(spark, docs):
    whole = language_model.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert whole[0] > whole[1]


class BruteModel:
    """Deleted interpolation with dictionaries; the weights are learned on exact, unbinned probabilities."""

    def __init__(self, train, deleted):
        self.all, self.kept = self.counts(train + deleted), self.counts(train)
        self.types = len(self.all[0])
        self.weights = {}
        seen = [(self.bucket(c, self.kept), self.ml(c, w, self.kept)) for words_ in deleted for c, w in zip([None, *words_], words_)]
        for b in range(language_model.BUCKETS):
            own = np.array([p for k, p in seen if k == b]).reshape(-1, 3)
            prior = np.array([0.4 * (b > 0), 0.5, 0.1])
            w = prior / prior.sum()
            for _ in range(100 if len(own) else 0):
                share = own * w
                sums = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + prior
                w = sums / sums.sum()
            self.weights[b] = w

    @staticmethod
    def counts(texts):
        one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip([None, *t], t))
        return one, two, len(texts), sum(one.values())

    @staticmethod
    def seen(context, counts):
        return counts[2] if context is None else counts[0][context]

    def bucket(self, context, counts):
        return math.ceil(math.log2(self.seen(context, counts) + 1))

    def ml(self, context, word, counts):
        return (counts[1][(context, word)] / max(self.seen(context, counts), 1), counts[0][word] / max(counts[3], 1), 1 / (self.types + 1))

    def probability(self, context, word):
        return float(np.dot(self.weights[self.bucket(context, self.all)], self.ml(context, word, self.all)))

    def score(self, text):
        return sum(math.log10(self.probability(c, w)) for c, w in zip([None, *text], text))


def test_language_model_against_brute_force(spark, docs):
    table = docs.select("doc_id", "text")
    gone = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(language_model.DELETED)) == 0
    rows = [(r["doc_id"], [*words(r["text"]), "\0end"], r["gone"]) for r in table.select("*", gone.alias("gone")).collect()]
    training = [(t, g) for d, t, g in rows if not held(d, 7, 2)]
    model = BruteModel([t for t, g in training if not g], [t for t, g in training if g])
    contexts = [None, "the", "zzz-never-seen", *list(model.all[0])[:5]]
    for c in contexts:
        assert sum(model.probability(c, w) for w in [*model.all[0], "\0unknown"]) == pytest.approx(1)
    by_id = {d: t for d, t, _ in rows}
    for r in language_model.score(table).collect():
        assert r["score"] == pytest.approx(model.score(by_id[r["doc_id"]]), rel=2e-3)


def test_language_model_without_training_text(spark):
    only = next(i for i in range(100) if held(i, 7, 2))
    rows = language_model.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [(r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(0, 0.0, 0.0)]


def test_language_model_weights():
    weights = language_model.learn([(3, 20, 40, 10), (3, 0, 60, 5), (0, 0, 0, 2)], 100)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and not weights[0, 0] and (weights[1:] > 0).all()


def test_messages_grow_with_the_corpus():
    """FAN messages at most for each chunk and merged batch, and few levels."""
    assert [language_model.levels_of(n) for n in (0, 1, 256, 257, 65_536, 65_537)] == [1, 1, 1, 2, 2, 3]


def test_packing_round_trips():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (language_model.unpack_keys(language_model.pack_keys(keys)) == keys).all()
    counts = np.array([0, 1, 70_000, 1 << 40])
    assert (language_model.unpack_counts(language_model.pack_counts(counts)) == counts).all()


# Queries --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, duck, data, name):
    from parity import same

    same(queries.queries()[name](spark, data).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name,table", [(n, "conversations" if n.startswith("op6") else "documents") for n in sorted(queries.queries())])
def test_queries_cover_the_table(spark, data, name, table):
    out = queries.queries()[name](spark, data)
    rows = spark.read.parquet(f"{data}/{table}.parquet")
    if name.startswith("op7"):
        assert {"doc_id", "item_id"} <= set(out.columns)
    elif name == "media_pages":
        assert out.select("page_id").distinct().count() == spark.read.parquet(f"{data}/pages.parquet").count()
    elif name.startswith("op6"):
        assert out.count() == rows.select("conv_id").distinct().count() + 1
    else:
        assert out.count() == rows.count()
