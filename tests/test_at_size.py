"""Jobs whose rows, memory or rounds grew faster than their input."""

import pathlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import documents, graph, intervals, joins, retrieval, terms, vectors, windows
from quern.plans import registry, retrieval_queries
from quern.shared import shared_dir

from compare import rows_of_frame, rows_of_sql

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_nearest_in_tiles(spark, monkeypatch, metric):
    """Tiles of 40 rows; copies tie by id, a vector without numbers comes last, nothing is a row for each pair."""
    monkeypatch.setattr(retrieval, "TILE", 40)
    monkeypatch.setattr(retrieval, "QUERY_CHUNK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(150)]
    rows += [(150 + i, rows[i % 3][1]) for i in range(60)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got_frame = retrieval.nearest(df, df.where("id % 10 = 0"), "id", "v", 8, exclude_self=True, metric=metric)
    assert "BroadcastNestedLoopJoin" not in plan_of(got_frame) and "CartesianProduct" not in plan_of(got_frame)
    got = {}
    for r in got_frame.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    whole = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and None not in v}

    def score(a, b):
        if metric == "l2":
            return 1 / (1 + np.sqrt(((a - b) ** 2).sum()))
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return a @ b if metric == "dot" else a @ b / n if n else 0.0

    for q, _ in rows:
        if q % 10:
            continue
        others = [(i, score(whole[q], whole[i]) if q in whole and i in whole else None) for i, _ in rows if i != q]
        want = sorted(others, key=lambda x: (x[1] is None, -round(x[1], 9) if x[1] is not None else 0, x[0]))[:8]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for (_, a), (_, b) in zip(got[q], want))


def test_nearest_of_a_few_rows(spark):
    """Unknown vectors fill up a list that has room; a least score leaves them out."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 1.0])], "id long, v array<double>")
    got = retrieval.nearest(df, df.where("id = 0"), "id", "v", 5, exclude_self=True).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 3, 2] and got[2]["score"] is None
    assert [r["id"] for r in retrieval.nearest(df, df.where("id = 0"), "id", "v", 5, exclude_self=True, least=0.5).collect()] == [1]
    assert retrieval.nearest(df.where("id > 9"), df, "id", "v", 5).count() == 0


def test_index_in_blocks(spark, monkeypatch):
    """A sample fits the cells; all rows are indexed, and blocks of cells give the exact ten."""
    monkeypatch.setattr(retrieval, "TILE", 30)
    monkeypatch.setattr(retrieval, "FIT_VECTORS", 200)
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0")
    model, indexed = retrieval.ivf(v, "vec_id", "embedding", 8)
    assert model.summary.cluster.count() < 300 and indexed.count() == v.count()
    rows = lambda df: sorted((r["query"], r["rank"], r["id"]) for r in df.collect())
    assert rows(retrieval.search_ivf(model, indexed, q, "vec_id", "embedding", 10, 2)) == rows(retrieval.nearest(v, q, "vec_id", "embedding", 10))


def test_classes_as_pairs(spark):
    """Measures by counts of classes equal those by pairs; null classes and classes of one row have nothing relevant."""
    items = spark.createDataFrame([(i, None if i == 7 else 99 if i == 8 else i % 3) for i in range(30)], "id long, class int")
    queries = items.where("id < 10").withColumnRenamed("id", "query")
    run = spark.createDataFrame([(q, (q * 7 + r * 4) % 30, r) for q in range(10) for r in range(1, 13)], "query long, id long, rank int")
    pairs = queries.join(items, "class").where("query <> id").select("query", "id")
    of = lambda df: sorted(map(tuple, df.collect()))
    assert of(retrieval.class_measures(run, queries, items, 10)) == of(retrieval.measures(run, pairs, 10))


def test_measures_list_no_pairs(spark):
    """The query's plan joins no frame with itself by label alone."""
    plan = plan_of(retrieval_queries.measured(registry.Tables(spark, SF)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not any("Join" in line and line.count("label") >= 2 and "count" not in line and "vec_id" not in line for line in plan.splitlines())


def test_codes_in_chunks(spark, monkeypatch):
    """Few queries at once give the same ten as all at once."""
    monkeypatch.setattr(vectors, "QUERY_CHUNK", 3)
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    codes = vectors.quantised(v.select("vec_id", retrieval.unit(F.col("embedding")).alias("u")), "vec_id", "u")
    q = v.where("vec_id % 50 = 0")
    got, compared = vectors.search_quantised(codes, v, q, "vec_id", "embedding", 10)
    rows = lambda df: sorted((r["query"], r["rank"], r["id"]) for r in df.collect())
    assert rows(got) == rows(retrieval.nearest(v, q, "vec_id", "embedding", 10))
    assert compared.count() == q.count()


def test_nearest_control_makes_no_pairs(spark):
    """Hot cells, ties by gap and by score, ends of the caliper, nulls: as brute force, with a row a control score at most."""
    rng = np.random.default_rng(5)
    t = [(i, float(x)) for i, x in enumerate(np.round(rng.uniform(-3, 3, 300), 2))] + [(900, None)]
    c = [(1000 + i, float(x)) for i, x in enumerate(np.round(rng.uniform(-9, 9, 200), 1))] + [(1900, None)]
    left, right = (spark.createDataFrame(x, "id long, s double") for x in (t, c))
    got_frame = joins.nearest_control(left, right, "id", "s", 0.05)
    assert {r["treated"]: (r["control"], r["gap"]) for r in got_frame.collect()} == {
        i: (best[1], best[0]) for i, s in t if s is not None for best in [min((abs(s - x), k) for k, x in c if x is not None)] if best[0] <= 0.05
    }
    same = spark.range(20_000).select("id", F.lit(1.0).alias("s"))
    plan = joins.nearest_control(same, same, "id", "s", 0.05)
    assert plan.count() == 20_000  # 400 million pairs before
    assert plan.where("control = 0 AND gap = 0").count() == 20_000


def test_rolling_time_across_spans(spark):
    """As brute force, with equal times, nulls, gaps and windows that end at a row's time."""
    rng = np.random.default_rng(9)
    rows = [(i, "ab"[i % 2], None if i % 37 == 0 else int(rng.integers(0, 400)) * 5, None if i % 11 == 0 else float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, sec long, v double").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r["id"]: r for r in windows.rolling_time(df, "k", "ts", "v", 60).collect()}
    assert len(got) == 400
    for i, k, sec, _ in rows:
        w = [v for _, k2, s2, v in rows if k2 == k and v is not None and ((sec is None and s2 is None) or (sec is not None and s2 is not None and sec - 60 <= s2 <= sec))]
        r = got[i]
        assert r["n"] == len(w) and r["min"] == min(w, default=None) and r["max"] == max(w, default=None)
        assert (r["mean"], r["std"]) == (None, None) if not w else abs(r["mean"] - np.mean(w)) + abs(r["std"] - np.std(w)) < 1e-9
    plan = plan_of(windows.rolling_time(df, "k", "ts", "v", 60))
    assert "specifiedwindowframe(RangeFrame, -" not in plan  # sliding frames are read anew for each row


def test_no_path_is_one_row(spark, tmp_path):
    """Of shortest paths that do not exist SQL gives a row of nulls."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.where("p_partkey > 60").write.parquet(f"{tmp_path}/part.parquet")
    got = rows_of_frame(registry.QUERIES["gra_shortest_path"](spark, str(tmp_path)))
    assert got == (["hops", "path"], [("None", "None")]) == rows_of_sql(str(tmp_path), registry.ORACLES["gra_shortest_path"])


def test_two_rules_list_no_peers(spark, tmp_path):
    """20,000 suppliers of one nation: 400 million pairs of peers before."""
    spark.range(20_000).selectExpr("id AS s_suppkey", "CAST(3 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = registry.QUERIES["log_two_rules"](spark, str(tmp_path))
    assert got.where("a0 > 9999").groupBy("a1").count().collect() == [(1003, 20_000)]


def test_graph_loops_broadcast_no_edges(spark, tmp_path):
    """The files of a million regular edges are small, their rows are not: a broadcast beyond 2 MB is an error here."""
    spark.range(300_000).selectExpr("id AS src", "(id * 7 + 1) % 300000 AS dst").write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    assert sum(f.stat().st_size for f in (tmp_path / "e").glob("*.parquet")) < 10 << 20
    spark.conf.set("spark.sql.maxBroadcastTableSize", str(2 << 20))
    try:
        assert graph.distances(graph.undirected(e), spark.range(5, 6).withColumnRenamed("id", "node"), 3).count() > 3
        got = graph.pagerank(e, graph.degrees(e).select("node"), rounds=2)
        assert abs(got.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("cell", [3, 40, 10_000])
def test_rules_in_force_by_cells(spark, monkeypatch, cell):
    """Cells end within groups, times and rules; bounds may be open, equal, inverted or unknown."""
    monkeypatch.setattr(intervals, "CELL", cell)
    rnd = random.Random(5)
    group = lambda: rnd.choice(["a", "a", "a", "b", None, f"z{rnd.randrange(9)}"])
    some = lambda x: rnd.choice([x, x, x, None])
    ev = [(group(), rnd.randrange(150), some(rnd.choice([7, rnd.randint(-90, 90)]))) for _ in range(200)]
    ru = [(group(), some(1000 + rnd.randrange(150)), some(s), some(s + rnd.choice([0, 1, 9, 100, -1]))) for s in (rnd.choice([7, rnd.randint(-90, 90)]) for _ in range(150))]
    df_e, df_r = spark.createDataFrame(ev, "g string, ev long, at long"), spark.createDataFrame(ru, "g string, ru long, s long, e long")
    want = defaultdict(list)
    for g, k, at in ev:
        if g is not None and at is not None:
            want[k] += [r for h, r, s, e in ru if h == g and (s is None or s <= at) and (e is None or at <= e) and (s is None or e is None or s <= e)]
    got = intervals.in_force_summary(df_e, df_r, ["g"], "ev", "at", "ru", "s", "e").collect()
    assert {r["event"]: (r["n"], r["first"]) for r in got} == {k: (len(v), min((x for x in v if x is not None), default=None)) for k, v in want.items() if v}
    assert intervals.in_force_summary(df_e, df_r.where("false"), ["g"], "ev", "at", "ru", "s", "e").count() == 0
    assert intervals.in_force_summary(df_e.where("false"), df_r, ["g"], "ev", "at", "ru", "s", "e").count() == 0


def test_rules_in_force_make_no_pairs(spark):
    """20,000 open rules of one group and 20,000 events in all of them: 400 million pairs."""
    df = spark.range(20_000).selectExpr("1 AS g", "id", "id AS at", "CAST(NULL AS bigint) AS s", "20000 + id AS e")
    got = intervals.in_force_summary(df, df, ["g"], "id", "at", "id", "s", "e")
    assert "SortMergeJoin" not in plan_of(got)
    assert [tuple(r) for r in got.groupBy("n", "first").count().collect()] == [(20_000, 0, 20_000)]


def test_unification_moves_no_rows(spark):
    """One narrow pass; deep terms take no rounds."""
    deep = lambda inner: "f(" * 3000 + inner + ")" * 3000
    rows = [(1, deep("X"), deep("a")), (2, deep("X"), deep("g(X)")), (3, deep("a"), deep("b")), (4, "h(Z, X, g(Y))", "h(Y, X, g(Z))"), (5, "f(X, g(X))", "f(g(Y), Y)"), (6, "f(X, X, a)", "f(g(X), Y, b)"), (7, "h(A, B)", "h(g(B), k(C, c))")]
    got = terms.unified(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b")
    plan = plan_of(got)
    assert "Exchange" not in plan and "Join" not in plan
    found = {r["pair"]: (r["outcome"], [tuple(b) for b in r["bindings"]]) for r in got.collect()}
    assert found == {1: ("unified", [("X", "a")]), 2: ("occurs", []), 3: ("clash", []), 4: ("unified", [("Z", "Y")]), 5: ("occurs", []), 6: ("clash", []), 7: ("unified", [("A", "g(k(C, c))"), ("B", "k(C, c)")])}
    assert "Exchange" not in plan_of(registry.QUERIES["log_unified"](spark, SF))


def test_shapes_of_pairs_keep_names():
    """Pairs of one shape get their own names; equal and unequal names are other shapes; no text becomes a term by numbers."""
    assert terms.solve_by_shape("p(a, X)", "p(Y, q('0', a))") == terms.solve("p(a, X)", "p(Y, q('0', a))") == ("unified", [("X", "q('0', a)"), ("Y", "a")])
    assert terms.solve_by_shape("r(b, X)", "r(Y, s('1 x', b))") == ("unified", [("X", "s('1 x', b)"), ("Y", "b")])
    assert terms.solve_by_shape("p(a)", "p(a)")[0] == "unified" and terms.solve_by_shape("p(a)", "p(b)")[0] == "clash"
    for text in ("a'b'", "a b", "f(a", "f(,)", "a!b"):
        with pytest.raises(ValueError, match="term|missing"):
            terms.solve_by_shape(text, "a")


@pytest.mark.parametrize("classes", [8, 1 << 19])
def test_candidates_of_near_sets(spark, monkeypatch, classes):
    """All links are among the candidates, however coarse the counts; most other pairs are not."""
    monkeypatch.setattr(documents, "SKETCH", classes)
    rnd = random.Random(4)
    base = [rnd.sample(range(400), 40) for _ in range(60)]
    sets = [set(rnd.choice(base)) ^ set(rnd.sample(range(400), rnd.randrange(6))) for _ in range(150)] + [{1}, {1, 2}, set(range(20)), set(range(1, 20))]
    df = spark.createDataFrame([(i, sorted(map(str, s))) for i, s in enumerate(sets)], "k long, w array<string>")
    got = {tuple(r) for r in documents.near_candidates(df, 0.8).collect()}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.8}
    assert links and links <= got
    assert len(got) < len(sets) * (len(sets) - 1) / 4


def test_greedy_dedup_writes_little(spark):
    """Token sets are written once, and again only those of candidates."""
    rnd = random.Random(6)
    rows = [(i, " ".join(str(rnd.randrange(10**6, 10**7)) for _ in range(200))) for i in range(1000)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)]
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    got = documents.greedy_dedup(spark.createDataFrame(rows, "id long, text string"), "id", F.split("text", " "), 0.85)
    assert sorted(r["id"] for r in got.collect()) == list(range(1000))
    assert size() - before < 2 * sum(len(text) for _, text in rows)


def near_copies(rnd, groups, each, words, changes):
    """Texts of groups of sets that differ in up to so many words from one of their group, in any order."""
    texts = []
    for g in range(groups):
        base = [f"g{g}w{i}" if rnd.random() < 0.6 else f"common{rnd.randrange(50)}" for i in range(words)]
        for _ in range(each):
            text = list(base)
            for i in rnd.sample(range(words), rnd.randrange(changes + 1)):
                text[i] = f"x{rnd.randrange(10**6)}" if rnd.random() < 0.7 else ""
            texts.append(" ".join(w for w in text if w))
    rnd.shuffle(texts)
    return texts


def test_greedy_dedup_needs_no_pair_for_each_two_copies(spark):
    """2000 near copies have over a million links; what is written is of the size of the texts."""
    texts = near_copies(random.Random(8), 1, 2000, 100, 4)
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    got = documents.greedy_dedup(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", F.split("text", " "), 0.85)
    assert sorted(r["id"] for r in got.collect()) == greedy(texts, 0.85)
    assert size() - before < sum(map(len, texts))


def greedy(texts, threshold):
    kept = []
    for i, text in enumerate(texts):
        w = set(text.split(" ")) if text is not None else set()
        if not w or all(len(w & k) / len(w | k) <= threshold for _, k in kept if k):
            kept.append((i, w))
    return [i for i, _ in kept]


@pytest.mark.parametrize(("threshold", "changes"), [(0.4, 12), (0.7, 8), (0.85, 5), (0.95, 2)])
def test_greedy_dedup_in_rounds(spark, monkeypatch, threshold, changes):
    """Groups whose first copies do not link with all others, texts of few words, exact copies, none; keys that are strings."""
    monkeypatch.setattr(documents, "ROOM", 0)
    rnd = random.Random(changes)
    texts = near_copies(rnd, 3, 50, 30, changes) + near_copies(rnd, 4, 12, 7, 2) + [None, "a", "a", "b", None, "a b", "b a"]
    texts += rnd.sample(texts, 30)
    frame = spark.createDataFrame([(f"k{i:04}", text) for i, text in enumerate(texts)], "id string, text string")
    got = documents.greedy_dedup(frame, "id", F.split("text", " "), threshold)
    assert sorted(int(r["id"][1:]) for r in got.collect()) == greedy(texts, threshold)
