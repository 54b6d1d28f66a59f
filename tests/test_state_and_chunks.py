"""Folds over streams, adaptive chunks and the queries without SQL, against brute force."""

import datetime
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunks
from quern.operators import documents as D
from quern.operators import governance as V
from quern.operators import graph as G
from quern.operators import knowledge as K
from quern.plans import registry
from quern.streaming import events as E
from quern.streaming import state as S

SF = "/root/testdata/sf0.001"
EPOCH = datetime.datetime(2024, 1, 1)


# Streams


def arrivals(spark, folder, rows, batches):
    """Rows (key, id, second, value) in micro-batches of their order."""
    n = math.ceil(len(rows) / batches)
    for i in range(0, len(rows), n):
        part = [(k, e, EPOCH + datetime.timedelta(seconds=s), v) for k, e, s, v in rows[i : i + n]]
        spark.createDataFrame(part, "k string, id long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(folder)
    return E.event_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def sample_events(late):
    """Times with ties, silences and a null key; rows arrive up to half the lateness out of order."""
    rng, rows, at = random.Random(5), [], 0.0
    for i in range(160):
        at += rng.choice([0, 0, 1, 7, 30, 90] * 3 + [1500])
        v = None if i % 17 == 3 else 1000.0 if i % 41 == 40 else rng.random()
        rows.append((rng.choice(["a", "a", "b", None]), i, float(round(at)), v))
    return rows, sorted(rows, key=lambda r: r[2] + rng.random() * late / 2)


def settled_rows(rows, late):
    """By key, in order of time, what the watermark has passed."""
    mark, by = max(r[2] for r in rows) - late, defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if r[2] < mark:
            by[r[0]].append(r)
    return by


@pytest.mark.parametrize("batches", [1, 5])
def test_rate_limit_equals_a_fold(spark, tmp_path, batches):
    rows, sent = sample_events(600)
    got = E.drained(S.rate_limited(arrivals(spark, f"{tmp_path}/e", sent, batches), "k", "ts", "id", 2, 60), "append").collect()
    want = {}
    for mine in settled_rows(rows, 600).values():
        passed = []
        for _, i, s, _ in mine:
            recent = [x for x in passed if x > s - 60]
            want[i] = (len(recent) < 2, min(len(recent) + 1, 2))
            if len(recent) < 2:
                passed.append(s)
    assert len(got) == len(want) and not all(p for p, _ in want.values())
    assert {r["tie"]: (r["passed"], r["n"]) for r in got} == want
    assert {r["key"] for r in got} == {"a", "b", None}


@pytest.mark.parametrize("batches", [1, 5])
def test_rolling_history_equals_a_fold(spark, tmp_path, batches):
    rows, sent = sample_events(600)
    stream = arrivals(spark, f"{tmp_path}/e", sent, batches)
    got = E.drained(S.rolling_anomalies(stream, "k", "ts", "id", "v", window=8, z=2.0, least=3, keep=380), "append").collect()
    want, forgotten = {}, 0
    for mine in settled_rows(rows, 600).values():
        history, last = [], None
        for _, i, s, v in mine:
            if last is not None and s - last > 380:
                history, forgotten = [], forgotten + 1
            last, score = s, None
            if v is not None and len(history) >= 3 and np.std(history) > 0:
                score = abs(v - np.mean(history)) / np.std(history)
            level = None if score is None or score <= 2 else "critical" if score > 5 else "high" if score > 4 else "medium" if score > 3.5 else "low"
            want[i] = (len(history), None if score is None else round(score, 6), level)
            if v is not None:
                history = (history + [v])[-8:]
    assert forgotten and any(w[2] == "critical" for w in want.values())
    assert {r["tie"]: (r["n"], None if r["score"] is None else round(r["score"], 6), r["severity"]) for r in got} == want


# Chunks


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?؟])\s+", text.strip(" ")) if s.strip(" ")]


def tokens(text):
    return re.findall(r"\w+", text.lower())


def directions(said, dims):
    out = np.zeros((len(said), dims))
    for i, s in enumerate(said):
        at = {zlib.crc32(w.encode()) % dims for w in tokens(s)}
        out[i, list(at)] = 1 / math.sqrt(len(at)) if at else 0
    return out


def adaptive(text, low, target, high, dims, glued=()):
    """(first, sentences, words, coherence, density, text) over all pairs; glued: sentences a border may not follow."""
    said = sentences(text or "")
    if not said:
        return []
    u = directions(said, dims)
    near = np.array([u[i] @ u[i + 1] for i in range(len(said) - 1)])
    limit = near.mean() - near.std() / 2 - 1e-9 if len(near) else 0
    ends, size = [], 0
    for i, s in enumerate(said):
        size += len(s.split())
        drop = i < len(near) and near[i] < limit
        if i == len(said) - 1 or (size >= low and (size >= high or size >= 1.5 * target or (size >= target and drop))):
            ends.append(i + 1)
            size = 0
    out, first = [], 0
    for e in [e for e in ends if e - 1 not in glued]:
        x = np.array([r for r in u[first:e] if r.any()])
        k = len(x)
        pairs = [x[a] @ x[b] for a in range(k) for b in range(k) if a != b]
        density = min(1.0, 10 * x.var(axis=0).mean()) if k > 1 else 0.5
        out.append((first, e - first, sum(len(s.split()) for s in said[first:e]), round(float(np.mean(pairs)) if k > 1 else 1.0, 6), round(float(density), 6), " ".join(said[first:e])))
        first = e
    return out


def random_text(rng, n):
    topics = ["red green blue cyan pink grey".split(), "cat dog cow hen pig emu".split(), "one two six ten nil few".split()]
    return " ".join(" ".join(rng.choices(topics[i // 4 % 3], k=rng.randint(1, 9))).capitalize() + rng.choice(".!?") for i in range(n))


def test_adaptive_chunks_by_brute_force(spark):
    rng = random.Random(3)
    texts = {i: random_text(rng, n) for i, n in enumerate([1, 2, 3, 20, 60, 150, 150])}
    texts |= {7: None, 8: "", 9: "  \n ", 10: "... !!! ???", 11: "no end", 12: texts[4], 13: "same words here. " * 40, 14: random_text(rng, 3000)}
    docs = spark.createDataFrame(list(texts.items()), "chunk int, text string")
    got = defaultdict(list)
    rows = chunks.chunk_adaptive(docs.withColumnRenamed("chunk", "id"), "id", "text", 10, 20, 30, dims=64)
    for r in rows.orderBy("id", "chunk").collect():
        assert r["chunk"] == len(got[r["id"]])
        got[r["id"]].append((r["first"], r["n_sentences"], r["n_words"], round(r["coherence"], 6), round(r["density"], 6), r["text"]))
    for i, text in texts.items():
        want = adaptive(text, 10, 20, 30, 64)
        assert [x[:3] + x[5:] for x in got[i]] == [x[:3] + x[5:] for x in want]
        assert np.allclose([x[3:5] for x in got[i]], [x[3:5] for x in want], atol=2e-6)
    assert len(got[14]) > 300 and {x[1] for x in got[14]} != {1}


def test_adaptive_chunks_keep_entities_whole(spark):
    text = "Many words came to see old J. Smith went home. Then all of them left us. We saw A. Jones again there."
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    entity = r"\b[A-Z]\.\s[A-Z]\w+"
    glued = [i for i, s in enumerate(sentences(text)) if re.search(r"\b[A-Z]\.$", s)]
    assert glued == [0, 3]
    for low, target, high in ((1, 1, 1), (1, 5, 6)):
        free = [r["text"] for r in chunks.chunk_adaptive(docs, "id", "text", low, target, high).orderBy("chunk").collect()]
        kept = [r["text"] for r in chunks.chunk_adaptive(docs, "id", "text", low, target, high, entity).orderBy("chunk").collect()]
        assert kept == [x[5] for x in adaptive(text, low, target, high, 512, glued)]
        assert any(re.search(r"J\.$", c) for c in free) and any("J. Smith" in c for c in kept) and any("A. Jones" in c for c in kept)


def test_adaptive_chunks_are_one_narrow_pass(spark):
    plan = registry.QUERIES["doc_chunk_adaptive"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# Queries without SQL

TEXTS = {
    1: "ALPHA meets BETA and GAMMA 1234. Nothing here! ALPHA again, 555 and ALPHA?",
    2: "One. Two two two. PART one begins. It goes on and on.\nSECTION two is long. It has words. It has more words!\nNOTES end.",
    3: "a. b. c. " * 30,
    4: "",
    5: "no sentence end at all",
    6: "The contract cites Article 12 of the law and article 7 of the code. " * 12,
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id int, text string").cache()


def packed(parts, size):
    out, now = [], ""
    for p in parts:
        if now and len(now) + 1 + len(p) > size:
            out.append(now)
            now = ""
        now = f"{now} {p}" if now else p
    return out + [now] if now else out


def by_id(rows, *columns):
    out = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["id"], r["chunk"])):
        assert r["chunk"] == len(out[r["id"]])
        out[r["id"]].append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return dict(out)


def test_relations(spark, texts):
    pattern = r"\b[A-Z]{3,}\b|\b\d{3,}\b"
    want = []
    for i, t in TEXTS.items():
        for k, s in enumerate(sentences(t)):
            e = list(dict.fromkeys(re.findall(pattern, s)))
            want += [(i, k, a, b) for x, a in enumerate(e) for b in e[x + 1 :]]
    assert len(want) > 5
    assert sorted(map(tuple, D.relations(texts, "id", "text", pattern).collect())) == sorted(want)


def test_headings(spark, texts):
    want = {}
    for i, t in TEXTS.items():
        parts = [p for p in re.split(r"(?=\n[A-Z]{4,})", t) if p.strip(" ")]
        got = [c for p in parts for c in ([p] if len(p) <= 40 else packed(sentences(p), 40))]
        if got:
            want[i] = got
    assert by_id(D.chunk_headings(texts, "id", "text", r"\n[A-Z]{4,}", 40), "text") == want and len(want[2]) > 3


def test_breaks_by_overlap(spark, texts):
    want = {}
    for i, t in TEXTS.items():
        groups = []
        for k, s in enumerate(said := sentences(t)):
            a, b = set(tokens(s)), set(tokens(said[k - 1])) if k else set()
            if k == 0 or (len(a & b) / len(a | b) if a | b else 1.0) < 0.2:
                groups.append([])
            groups[-1].append(s)
        if groups:
            want[i] = [c for g in groups for c in packed(g, 60)]
    assert by_id(D.chunk_by_similarity(texts, "id", "text", 0.2, 60), "text") == want


def test_chunk_scores(spark, texts):
    got = {r["id"]: r["s"] for r in texts.select("id", D.chunk_score(F.col("text"), 5, 20).alias("s")).collect()}
    for i, t in TEXTS.items():
        w = t.split()
        n = len(w)
        fit = 1.0 if 5 <= n <= 20 else n / 5 if n < 5 else 20 / n
        end = 1.0 if re.search(r"[.!?؟]$", t.strip()) else 0.7
        assert got[i] == pytest.approx((fit + end + (min(1.0, 1.5 * len(set(w)) / n) if n else 0.0)) / 3)


def test_anchors(spark, texts):
    pieces = D.chunk_fixed(texts, "id", "text", 30, 0)
    want = {}
    for i, t in TEXTS.items():
        out, before = [], None
        for c in [t[k : k + 30] for k in range(0, len(t), 30)]:
            if before is not None and re.search(r"[Aa]rticle\s*$", before) and re.match(r"\s*\d+", c):
                out[-1] += " " + c
            else:
                out.append(c)
            before = c
        if out:
            want[i] = out
    assert by_id(K.anchored(pieces, "id", "chunk", "text", "[Aa]rticle"), "text") == want
    assert any(len(c) > 31 for c in want[6])


def test_answer_scores(spark):
    rows = [(1, "What is the law", "The law is a rule. It binds us all.", "the law is a rule that binds"), (2, "why", "", "why"), (3, "a b", "c d e f", "x"), (4, "one two three", "one two three one two three!", "one two three one")]
    df = spark.createDataFrame(rows, "id int, q string, a string, s string")
    got = {r["id"]: r for r in df.select("id", *[v.alias(k) for k, v in K.qa_scores(F.col("q"), F.col("a"), F.col("s")).items()]).collect()}
    share = lambda part, whole: len(set(part) & set(whole)) / len(set(part)) if part else 0.0
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for i, q, a, s in rows:
        tq, ta, ts = tokens(q), tokens(a), tokens(s)
        want = {
            "relevance": len(set(tq) & set(ta)) / len(set(tq) | set(ta)),
            "groundedness": (share(ta, ts) + share(grams(ta), grams(ts))) / 2,
            "coherence": 0.5 * (1.0 if re.search(r"[.!?؟]$", a.strip()) else 0.5) + 0.5 * (len(set(ta)) / len(ta) if ta else 0.0),
            "completeness": min(1.0, len(ta) / 30) * 0.7 + min(1.0, len([x for x in re.split("[.!?؟]+", a) if x.strip()]) / 2) * 0.3,
        }
        want["quality"] = 0.25 * want["relevance"] + 0.35 * want["groundedness"] + 0.2 * want["coherence"] + 0.2 * want["completeness"]
        for k, v in want.items():
            assert got[i][k] == pytest.approx(v), (i, k)


def test_unwanted_parts_go(spark):
    rows = ["see https://a.b/c?d=1 now", "mail me@x.org or @you #tag", "<b>bold</b>   text", "soooooo good", "wwww.x", "plain text stays"]
    want = []
    for t in rows:
        for p in (r"https?://\S+|www\.\S+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"[@#]\w+", r"<[^>]+>", r"(.)\1{3,}"):
            t = re.sub(p, "", t)
        want.append(re.sub(r"\s+", " ", t).strip())
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert [r["x"] for r in df.select("i", T.without_unwanted(F.col("t")).alias("x")).orderBy("i").collect()] == want


def test_label_propagation(spark):
    rng = random.Random(1)
    edges = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a != b})
    near = defaultdict(list)
    pairs = G.undirected(spark.createDataFrame(edges, "src int, dst int")).collect()
    for a, b in ((r["src"], r["dst"]) for r in pairs):
        near[a].append(b)
    assert {(min(a, b), max(a, b)) for a in near for b in near[a]} == {(min(e), max(e)) for e in edges}
    labels = {n: n for n in near}
    for _ in range(4):
        votes = {n: Counter(labels[m] for m in near[n]) for n in near}
        labels = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}
    got = G.label_propagation(spark.createDataFrame(edges, "src int, dst int"), 4).collect()
    assert {r["node"]: r["label"] for r in got} == labels


def test_weights_learned_one_by_one(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, [rng.random(), rng.random()] if k % 11 else None, rng.random() if k % 7 else None) for k in range(400)]
    got = K.adapted_weights(spark.createDataFrame(rows, "run int, at int, s array<double>, r double"), "run", "at", "s", "r", 2)
    for row in got.collect():
        w, k = [0.5, 0.5], 0
        for _, _, s, r in (x for x in rows if x[0] == row["run"]):
            if s is None or r is None:
                continue
            raw = [max(x + 0.1 * 0.9 ** (k // 100) * (r - y) * y, 0.0) for x, y in zip(w, s)]
            w, k = [x / (sum(raw) + 1e-12) for x in raw], k + 1
        assert row["weights"] == pytest.approx(w)


def test_splits_follow_the_key(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    shares = {"train": 0.8, "valid": 0.1, "test": 0.1}
    a = {r["k"]: r["split"] for r in V.split(df, "k", shares).collect()}
    b = {r["k"]: r["split"] for r in V.split(df.where("k % 3 = 0").repartition(5), "k", shares).collect()}
    assert all(a[k] == s for k, s in b.items())  # what is beside a row does not move it
    for name, n in Counter(a.values()).items():
        assert abs(n / 20000 - shares[name]) < 4 * math.sqrt(shares[name] * (1 - shares[name]) / 20000)


def test_doubly_robust_by_hand(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=600)
    e = 1 / (1 + np.exp(-x))
    t = (rng.random(600) < e).astype(int)
    y = 2.0 * t + 1.5 * x + rng.normal(size=600)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(t, y, e, x)], "t double, y double, e double, x double")
    fit = [np.polyfit(x[t == arm], y[t == arm], 1) for arm in (0, 1)]
    m0, m1 = (np.polyval(f, x) for f in fit)
    p = np.clip(e, 0.01, 0.99)
    d = m1 - m0 + t * (y - m1) / p - (1 - t) * (y - m0) / (1 - p)
    got = V.doubly_robust(df, "t", "y", "e", ["x"]).first()
    assert got["ate"] == pytest.approx(d.mean(), abs=1e-6) and got["se"] == pytest.approx(d.std() / math.sqrt(600), abs=1e-6)
    assert abs(got["ate"] - 2.0) < 4 * got["se"]


def test_bootstrap_covers_the_normal_interval(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(10, 3, size=3000)
    got = V.bootstrap_interval(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", rounds=400).first()
    half = 1.96 * v.std() / math.sqrt(3000)
    assert got["low"] == pytest.approx(v.mean() - half, abs=0.35 * half) and got["high"] == pytest.approx(v.mean() + half, abs=0.35 * half)


def test_superseded_results_are_replaced(spark):
    results = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (1, 4, 0.4), (2, 1, 0.2), (2, 9, 0.7)], "query int, id int, score double")
    probe = registry.QUERIES["kno_resolved_results"](spark, SF)
    assert probe.groupBy("id").count().where("count > 1").isEmpty()
    from quern.plans import knowledge_queries

    edges = knowledge_queries.supersedes(registry.Tables(spark, SF))
    names = edges.columns
    small = spark.createDataFrame([(2, 1), (3, 2)], f"{names[0]} int, {names[1]} int")
    chains = {r["start"]: r["latest"] for r in K.supersession_chains(small).collect()}
    want = defaultdict(float)
    for q, i, s in results.collect():
        want[q, chains.get(i, i)] = max(want[q, chains.get(i, i)], s)
    got = {(r["query"], r["id"]): r["score"] for r in K.resolve_supersession(results, small).collect()}
    assert got == dict(want) and len(set(chains.values())) == 1
