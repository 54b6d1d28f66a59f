"""Operators that SQL does not express, against plain Python; and edge cases."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import aggregates as A
from quern.operators import documents as D
from quern.operators import filters as P
from quern.operators import governance as V
from quern.operators import graph as G
from quern.operators import logic as L
from quern.operators import retrieval as S
from quern.operators import windows as W
from quern.sources import readers, writers


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, "T", 1.0, None) for i, (a, b) in enumerate(pairs)], "id long, src long, dst long, type string, weight double, confidence double")


def test_query_builder_needs_a_tenant(spark):
    df = spark.range(5).withColumn("tenant", F.lit("a"))
    with pytest.raises(ValueError):
        P.NodeQuery(df).build()
    assert P.NodeQuery(df).for_tenant("tenant", "a").order_by("id", True).skip(1).limit(2).build().collect()[0]["id"] == 3


@pytest.mark.parametrize("text", ["DROP INDEX x", "match (n) detach delete n", "DELETE ALL"])
def test_destructive_statements(text):
    with pytest.raises(ValueError):
        P.validate_query_text(text)
    P.validate_query_text("MATCH (n) WHERE n.a = 1 DELETE n")


def test_graph_on_cycles_and_diamonds(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (5, 6)])
    hops = {r["node"]: r["hops"] for r in G.distances(e, spark.createDataFrame([(1,)], "node long"), 5).collect()}
    assert hops == {1: 0, 2: 1, 4: 1, 3: 2}
    comp = {r["node"]: r["component"] for r in G.components(e).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    assert G.shortest_path(e, 1, 3, 5).first()["nodes"] == [1, 2, 3]
    assert G.shortest_path(e, 3, 6, 5).count() == 0
    ranks = {r["node"]: r["rank"] for r in G.pagerank(e, G.degrees(e).select("node"), 20).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9


def test_components_on_random_graphs(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in G.components(edges(spark, pairs)).collect()}
    assert got == {n: root(n) for n in parent}


def test_betweenness_of_a_path(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4)])
    got = {r["node"]: (r["betweenness"], round(r["closeness"], 4)) for r in G.brandes(e, G.degrees(e).select("node")).collect()}
    assert got == {1: (0, 0.5), 2: (2, 0.75), 3: (2, 0.75), 4: (0, 0.5)}


def test_expand_takes_the_first_visit(spark):
    rows = [(0, 1, 2, "A", None), (1, 1, 3, "B", None), (2, 2, 4, "A", None), (3, 3, 4, "A", None), (4, 4, 5, "C", None)]
    e = spark.createDataFrame(rows, "id long, src long, dst long, type string, confidence double")
    got = {(r["node"], r["hop"]): round(r["score"], 4) for r in G.expand(e, spark.createDataFrame([(1, 1.0)], "node long, score double"), 3, {"A": 1.0, "B": 0.5}).collect()}
    assert got == {(2, 1): 0.7, (3, 1): 0.35, (4, 2): 0.49}


def test_traverse_uses_each_edge_once(spark):
    e = edges(spark, [(1, 2), (1, 2), (2, 3)])
    got = G.traverse(e, 1, 3, "bfs", 100).collect()
    assert len(got) == 2 + 2 + 2 + 0  # two edges; back by the other or on to 3


def test_greedy_dedup_is_sequential(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.sample("abcdefghij", 7))) for i in range(60)]
    kept = []
    for i, text in rows:
        w = set(text.split())
        if all(len(w & k) / len(w | k) <= 0.7 for _, k in kept):
            kept.append((i, w))
    got = D.greedy_dedup(spark.createDataFrame(rows, "id long, text string"), "id", F.split("text", " "), 0.7)
    assert sorted(r["id"] for r in got.collect()) == [i for i, _ in kept]


def test_chunks_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "One two. Three four! Five?  Six seven eight nine ten."), (2, ""), (3, "x" * 1300)], "id long, text string")
    fixed = D.chunk_fixed(docs, "id", "text", 512, 50).where("id = 3").orderBy("chunk").collect()
    assert [len(r["text"]) for r in fixed] == [512, 512, 376]
    packed = [r["text"] for r in D.chunk_sentences(docs, "id", "text", 22).where("id = 1").orderBy("chunk").collect()]
    assert packed == ["One two. Three four!", "Five?", "Six seven eight nine ten."]
    assert D.chunk_words(docs, "id", "text", 3).where("id = 2").count() == 0
    assert " ".join(r["text"] for r in D.chunk_words(docs, "id", "text", 3).where("id = 1").orderBy("chunk").collect()) == "One two. Three four! Five? Six seven eight nine ten."


def test_text_functions(spark):
    df = spark.createDataFrame([("mail a.b@c.org or 10.0.0.1 !!!!!! <b>x</b> http://u.v/w",)], "t string")
    r = df.select(T.redact(F.col("t")).alias("r"), T.clean(F.col("t")).alias("c"), T.scrub(F.col("t")).alias("s"), T.is_safe(F.col("t")).alias("ok")).first()
    assert "[EMAIL]" in r["r"] and "[IP]" in r["r"] and not r["ok"]
    assert r["c"] == "mail or 10.0.0.1 !! x"
    assert "[EMAIL_" + hashlib.sha256(b"a.b@c.org").hexdigest()[:8] + "]" in r["s"]


def test_mmr_is_greedy(spark):
    rows = [(1, i, 1 - i / 10) for i in range(4)]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "id long, vector array<double>")
    got = S.mmr(spark.createDataFrame(rows, "query long, id long, score double"), vectors, 3, 0.5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 2, 3]


def test_rules(spark):
    facts = {"edge": spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")}
    rules = [L.parse_rule("path(X, Y) :- edge(X, Y)"), L.parse_rule("path(X, Z) :- path(X, Y), path(Y, Z)")]
    assert L.infer(facts, rules)["path"].count() == 1275
    with pytest.raises(ValueError):
        L.parse_rule("p(X, Y) :- edge(X, Z)")
    with pytest.raises(ValueError):
        L.parse_atom("p(f(X))")
    with pytest.raises(RuntimeError):
        L.infer(facts, [L.parse_rule("path(X, Y) :- edge(X, Y)"), L.parse_rule("path(X, Z) :- path(X, Y), edge(Y, Z)")], rounds=3)


def test_allen_covers_all_relations(spark):
    pairs = [((a, b), (c, d)) for a, b in itertools.combinations(range(5), 2) for c, d in itertools.combinations(range(5), 2)]
    df = spark.createDataFrame([(*x, *y) for x, y in pairs], "a int, b int, c int, d int")
    got = {r["r"] for r in df.select(L.allen(*map(F.col, "abcd")).alias("r")).collect()}
    assert len(got) == 13
    legacy = {r["r"] for r in df.select(L.allen(*map(F.col, "abcd"), touching=False).alias("r")).collect()}
    assert legacy == got - {"MEETS", "MET_BY"}


def test_chain_detects_changes(spark):
    df = V.chained(spark.createDataFrame([("c", i, f"e{i}") for i in range(5)], "chain string, n long, body string"), "chain", "n", "body")
    assert V.verify_chain(df, "chain", "n", "body").count() == 0
    broken = df.withColumn("body", F.when(F.col("n") == 2, "x").otherwise(F.col("body")))
    assert [r["n"] for r in V.verify_chain(broken, "chain", "n", "body").collect()] == [2]


def test_bandits_and_statistics(spark):
    assert V.sample_size(0.5) == 63
    df = spark.createDataFrame([("r", i, "ab"[i % 2], float(i % 2)) for i in range(6)], "run string, n long, arm string, reward double")
    w = [1.0, 1.0]
    for i in range(6):
        k = i % 2
        p = 0.9 * w[k] / sum(w) + 0.05
        w[k] *= math.exp(0.1 * (i % 2) / p / 2)
    got = V.exp3(df, "run", "n", "arm", "reward", ["a", "b"]).first()["weights"]
    assert got == pytest.approx(w)
    low_high = V.bootstrap_interval(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v", 100).first()
    assert 440 < low_high["low"] < 499.5 < low_high["high"] < 560


def test_empty_frames(spark):
    events = spark.createDataFrame([], "k string, ts timestamp, v double, id long")
    assert A.bottlenecks(events, "k", "v").count() == 0
    assert W.rolling_count(events, "k", ["ts"], "v", 3).count() == 0
    assert W.suppress_repeats(events, "k", F.unix_micros("ts") / 1e6, "id", 5).count() == 0
    assert G.components(edges(spark, [])).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query long, text string")
    assert S.bm25(docs, q, T.words).count() == 0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "1", "text": "x"}\nnot json\n')
    (tmp_path / "in" / "b.txt").write_text("hello\n\n  there ")
    (tmp_path / "in" / "c.csv").write_text('id,text\n2,"y, z"\n')
    from pyspark.sql import types as Ty

    schema = Ty.StructType([Ty.StructField("id", Ty.StringType()), Ty.StructField("text", Ty.StringType())])
    got = readers.read_any(spark, f"{tmp_path}/in/a.jsonl", schema)
    assert got.where("_corrupt_record IS NULL").count() == 1
    assert readers.load_status(got).first()["failed"] == 1
    assert readers.read_any(spark, f"{tmp_path}/in/c.csv", schema).first()["text"] == "y, z"
    assert readers.read_any(spark, f"{tmp_path}/in/b.bin", schema).count() == 0
    assert readers.read_lines(spark, f"{tmp_path}/in/b.txt").count() == 2
    assert readers.discover(spark, f"{tmp_path}/in", "*.txt").count() == 1
    assert readers.read_texts(spark, f"{tmp_path}/in").first()["hash"] == hashlib.sha256(b"hello\n\n  there ").hexdigest()
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k long, v string")
    writers.upsert_to(old, new, ["k"], f"{tmp_path}/out", F.col("v"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, "a"), (2, "c"), (3, "e")]
    writers.write_splits(old.withColumn("split", F.lit("train")), f"{tmp_path}/splits")
    assert (tmp_path / "splits" / "split=train").is_dir()


def test_stream_upsert_and_rejects(spark, tmp_path):
    from quern.streaming import events as E

    src = tmp_path / "src"
    spark.createDataFrame([(1, 5.0), (2, None)], "k long, v double").write.parquet(str(src))
    stream = spark.readStream.schema("k long, v double").parquet(str(src))
    good, bad = [], []
    q = E.upsert_batches(stream, lambda b, e: good.extend(b.collect()), str(tmp_path / "ck"), F.col("v").isNotNull(), lambda b, e: bad.extend(b.collect()))
    q.awaitTermination()
    assert [r["k"] for r in good] == [1] and [r["k"] for r in bad] == [2]


def test_marked_up_files(spark, tmp_path):
    import zipfile

    from pyspark.sql import types as Ty

    (tmp_path / "a.xml").write_text("<r><law><no>1</no><name>x</name></law><law><no>2</no></law></r>")
    schema = Ty.StructType([Ty.StructField("no", Ty.IntegerType()), Ty.StructField("name", Ty.StringType())])
    assert sorted(map(tuple, readers.read_xml(spark, f"{tmp_path}/a.xml", "law", schema).collect())) == [(1, "x"), (2, None)]
    html = "<html><style>b{}</style><p>One &amp;  two</p><!-- no --><script>x<y</script><div>three</div></html>"
    assert spark.createDataFrame([(html,)], "h string").select(readers.html_text(F.col("h")).alias("t")).first()["t"] == "One & two\nthree"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:t>He</w:t><w:t>llo</w:t></w:p><w:p><w:t>you</w:t></w:p></w:document>')
    (tmp_path / "c.docx").write_text("no zip")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.read_docx(spark, str(tmp_path)).collect()}
    assert got == {"b.docx": "Hello\nyou", "c.docx": None}


def test_streams_of_part_files(spark, tmp_path):
    """A table of many part files is streamed whole, and in several micro-batches."""
    from pyspark.sql import functions as F

    from quern.plans import registry
    from quern.streaming import events as E

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("str_tumbling", "str_deduplicated", "str_alerts", "str_rejects"):
        folder = registry.QUERIES[name](spark, str(tmp_path))
        file = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert sorted(map(tuple, folder.collect())) == sorted(map(tuple, file.collect()))
    ordered = source.orderBy("ts").repartitionByRange(5, "ts")
    ordered.write.parquet(f"{tmp_path}/ordered")
    stream = E.event_stream(spark, f"{tmp_path}/ordered", source.schema, files_per_batch=1).withColumn("ts", F.col("ts").cast("timestamp"))
    got = E.drained(E.suppressed_alerts(stream.withColumn("all", F.lit("x")), "all", "ts", 600.0, late="20000 days"), "append").collect()
    times = sorted(r[0] for r in source.select(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).collect())
    want, last = [], None
    for x in times:
        if last is None or x - last >= 600:
            want.append(x)
            last = x
    # files come in any order, so a later batch may hold earlier times: nothing is sent twice within the time
    sent = sorted(r["t"] for r in got)
    assert 0 < len(sent) <= len(want) and all(b - a >= 600 for a, b in zip(sent, sent[1:]))


def test_betweenness_on_frames(spark):
    import itertools
    import random
    from collections import deque

    from quern.operators import graph as G

    rnd = random.Random(3)
    pairs = {tuple(sorted(rnd.sample(range(14), 2))) for _ in range(22)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def shortest(s):
        dist, count, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            v = queue.popleft()
            for w in near[v]:
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        return dist, count

    found = {v: shortest(v) for v in near}
    want = {v: sum(found[s][1][v] * found[v][1][t] / found[s][1][t] for s, t in itertools.combinations(near, 2) if v not in (s, t) and t in found[s][0] and v in found[s][0] and found[s][0][v] + found[v][0].get(t, 99) == found[s][0][t]) for v in near}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = {r["node"]: r for r in G.brandes(edges, G.degrees(edges).select("node")).collect()}
    for v in near:
        assert abs(got[v]["betweenness"] - want[v]) < 1e-9
        d = found[v][0]
        assert abs(got[v]["closeness"] - (len(d) - 1) / sum(d.values())) < 1e-9


def test_communities_by_modularity(spark):
    """Two cliques with one bridge come apart; the modularity is that of the definition."""
    import itertools

    from quern.operators import graph as G

    edges = [*itertools.combinations(range(6), 2), *itertools.combinations(range(10, 16), 2), (5, 10)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["community"] for r in G.modularity_move(df, 8).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[15]
    q = G.modularity(df, spark.createDataFrame(list(got.items()), "node long, community long")).first()[0]
    m = len(edges)
    degree = {v: sum(v in e for e in edges) for v in got}
    want = sum((sum((a, b) in ((x, y), (y, x)) for x, y in edges)) / (2 * m) - degree[a] * degree[b] / (2 * m) ** 2 for a in got for b in got if got[a] == got[b])
    assert abs(q - want) < 1e-9


def test_wilcoxon_by_hand(spark):
    import random

    from quern.operators import retrieval as S

    rnd = random.Random(1)
    rows = [(float(rnd.randint(0, 9)), float(rnd.randint(0, 9))) for _ in range(60)]
    d = sorted((a - b for a, b in rows if a != b), key=abs)
    rank = lambda x: sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2
    got = S.wilcoxon(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert (got["n"], got["w_plus"], got["w_minus"]) == (len(d), sum(rank(x) for x in d if x > 0), sum(rank(x) for x in d if x < 0))


def test_causal_models(spark):
    import numpy as np

    from quern.operators import causal as C

    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = 2 * x + 1 + rng.normal(size=400)
    z = y - 0.5 * x + rng.normal(size=400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z)], "x double, y double, z double")
    model = C.fit(df, {"y": ["x"], "z": ["y", "x"]})
    want = np.linalg.lstsq(np.c_[y, x, np.ones(400)], z, rcond=None)[0]
    assert np.allclose([model["z"][0]["y"], model["z"][0]["x"], model["z"][1]], want)
    r = C.counterfactual(df, model, {"x": 3.0}).first()
    b = model["y"][0]["x"]
    assert abs(r["cf_y"] - (r["y"] + b * (3 - r["x"]))) < 1e-9
    assert abs(r["cf_z"] - (r["z"] + model["z"][0]["y"] * b * (3 - r["x"]) + model["z"][0]["x"] * (3 - r["x"]))) < 1e-9
    # doing what was is what was
    same = C.counterfactual(df.limit(1), model, {"x": df.first()["x"]}).first()
    assert abs(same["cf_z"] - same["z"]) < 1e-9


def test_causal_skeleton(spark):
    """A chain keeps no edge between its ends; a collider is found."""
    import numpy as np

    from quern.operators import causal as C

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=3000), rng.normal(size=3000)
    c = a + b + rng.normal(size=3000)
    d = c + rng.normal(size=3000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, d)], "a double, b double, c double, d double")
    found = C.skeleton(df, ["a", "b", "c", "d"], critical=3.0)
    assert {e for e, g in found.items() if g is None} == {("a", "c"), ("b", "c"), ("c", "d")}
    assert found[("a", "d")] == ("c",)
    assert sorted(C.oriented(["a", "b", "c", "d"], found)) == [("a", "c", "->"), ("b", "c", "->"), ("c", "d", "->")]


def test_power_and_temperature(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from quern.operators import governance as V

    assert abs(V.power(0.5, 64) - 0.8) < 0.01 and V.power(0.5, 200) > V.power(0.5, 100)
    rnd = random.Random(4)
    rows = [(x, int(rnd.random() < 1 / (1 + math.exp(-x / 3)))) for x in (rnd.uniform(-12, 12) for _ in range(4000))]
    t = V.temperature(spark.createDataFrame(rows, "x double, y int"), "x", "y")
    assert 2 < t < 4.5
    assert abs(spark.range(1).select(V.tempered(F.lit(3.0), 3.0)).first()[0] - 1 / (1 + math.exp(-1))) < 1e-12


def test_merkle_proofs_lead_to_the_root(spark):
    import hashlib

    from pyspark.sql import functions as F

    from quern.operators import governance as V

    leaves = spark.range(13).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    root = V.merkle_root(leaves, "h").first()[0]
    proofs = {}
    for r in V.merkle_proofs(leaves, "h", leaves).collect():
        proofs.setdefault(r["h"], []).append((r["level"], r["sibling"], r["side"]))
    assert len(proofs) == 13
    for leaf, steps in proofs.items():
        now = leaf
        for _, sibling, side in sorted(steps):
            now = hashlib.sha256((now + sibling if side == "right" else sibling + now).encode()).hexdigest()
        assert now == root


def test_full_text_needs_every_term(spark):
    from quern.functions import text as T
    from quern.operators import retrieval as S

    docs = spark.createDataFrame([(1, "red green blue"), (2, "red green"), (3, "blue red red"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red blue"), (2, "green"), (3, "absent red")], "query long, text string")
    got = S.full_text(docs, queries, T.tokens)
    assert sorted((r["query"], r["id"]) for r in got.collect()) == [(1, 1), (1, 3), (2, 1), (2, 2)]
