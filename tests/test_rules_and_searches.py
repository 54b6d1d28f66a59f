"""Rule memories, proofs, terms, graph searches, interval joins and coded vectors against brute force."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators import graph_search, intervals, rules, terms, vectors
from quern.operators import logic as L
from quern.operators import retrieval

PATH = [L.parse_rule("path(X, Y) :- edge(X, Y)"), L.parse_rule("path(X, Z) :- path(X, Y), edge(Y, Z)")]
#: Two predicates that depend on each other, a constant, a repeated variable and premises in an awkward order.
MUTUAL = [
    L.parse_rule("even(X, Z) :- odd(X, Y), edge(Y, Z)"),
    L.parse_rule("odd(X, Y) :- edge(X, Y)"),
    L.parse_rule("odd(X, Z) :- even(X, Y), edge(Y, Z)"),
    L.parse_rule("loop(X) :- even(X, X)"),
    L.parse_rule("far(X, W) :- loop(X), from_one(W), edge(X, W)"),
    L.parse_rule("from_one(Y) :- even(1, Y)"),
]


def model_by_hand(facts, program):
    """{predicate: set of tuples} by naive rounds."""
    known = defaultdict(set, {p: set(rows) for p, rows in facts.items()})
    while True:
        before = sum(map(len, known.values()))
        for rule in program:
            bindings = [{}]
            for atom in rule.body:
                more = []
                for b in bindings:
                    for row in known[atom.predicate]:
                        c = dict(b)
                        if all((c.setdefault(a, v) == v) if L.is_variable(a) else str(v) == a for a, v in zip(atom.args, row)):
                            more.append(c)
                bindings = more
            known[rule.head.predicate] |= {tuple(b[a] if L.is_variable(a) else a for a in rule.head.args) for b in bindings}
        if sum(map(len, known.values())) == before:
            return known


def frame(spark, rows, n=2):
    return spark.createDataFrame(sorted(rows), ", ".join(f"x{i} long" for i in range(n)))


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_memory_equals_a_model_built_anew(spark, tmp_path):
    rnd, program = random.Random(4), MUTUAL
    heads = {r.head.predicate: len(r.head.args) for r in program}
    schemas = {"edge": "long, long"} | {p: ", ".join(["long"] * n) for p, n in heads.items()}
    path = f"file://{tmp_path}/memory"
    edges = {(rnd.randint(1, 9), rnd.randint(1, 9)) for _ in range(10)}
    memory = rules.RuleMemory(spark, path, program, schemas)
    memory.apply({"edge": frame(spark, edges)})
    for batch in range(2):
        gone = set(rnd.sample(sorted(edges), 3)) | {(77, 78)}
        new = {(rnd.randint(1, 9), rnd.randint(1, 9)) for _ in range(2)}
        edges = (edges - gone) | new
        if batch % 2:  # a later run reads what is stored
            memory = rules.RuleMemory(spark, path, program, schemas)
        memory.apply({"edge": frame(spark, new)}, {"edge": frame(spark, gone)})
        want = model_by_hand({"edge": edges}, program)
        for p in schemas:
            assert rows_of(memory.relation(p)) == want[p], (batch, p)
        assert rows_of(memory.relation("edge", "base")) == edges


def test_asserted_facts_outlive_their_proofs(spark, tmp_path):
    memory = rules.RuleMemory(spark, f"file://{tmp_path}/m", PATH, {"edge": "long, long", "path": "long, long"})
    memory.apply({"edge": frame(spark, {(1, 2), (2, 3)}), "path": frame(spark, {(1, 3), (8, 9)})})
    assert memory.apply(deletes={"edge": frame(spark, {(2, 3)})}) == {"edge": (0, 1), "path": (0, 1)}
    assert rows_of(memory.relation("path")) == {(1, 2), (1, 3), (8, 9)}
    assert memory.apply() == {}


def test_work_follows_the_delta(spark, tmp_path):
    """One edge at the end of one of many chains: rounds look at that chain only."""
    chains = {(100 * c + i, 100 * c + i + 1) for c in range(60) for i in range(5)}
    memory = rules.RuleMemory(spark, f"file://{tmp_path}/m", PATH, {"edge": "long, long", "path": "long, long"})
    memory.apply({"edge": frame(spark, chains)})
    assert memory.relation("path").count() == 60 * 15
    memory.log.clear()
    assert memory.apply({"edge": frame(spark, {(305, 306)})}) == {"edge": (1, 0), "path": (6, 0)}
    assert memory.apply(deletes={"edge": frame(spark, {(305, 306)})}) == {"edge": (0, 1), "path": (0, 6)}
    assert sum(rows for *_, rows in memory.log) == 14
    assert sum(p["rows"] for p in memory.parts if p["folder"].split("/")[1][0] != "0") == 16


def costs_by_hand(edges):
    """Least cost of path(a, b): hops, as each step costs one."""
    best = {}
    for a in {a for a, _ in edges}:
        front, hops, seen = {a}, 0, set()
        while front:
            hops += 1
            front = {d for s, d in edges if s in front} - seen
            seen |= front
            best |= {(a, b): hops for b in front}
    return best


def test_cheapest_proofs(spark):
    rnd = random.Random(6)
    edges = {(rnd.randint(1, 12), rnd.randint(1, 12)) for _ in range(30)}
    proofs = rules.derivations({"edge": frame(spark, edges)}, PATH)
    rows = {(r["predicate"], tuple(map(int, r["args"]))): r for r in proofs.collect()}
    want = costs_by_hand(edges)
    assert {k[1]: r["cost"] for k, r in rows.items() if k[0] == "path"} == want
    assert {k[1] for k in rows if k[0] == "edge"} == edges
    for (p, args), r in rows.items():  # every step is an instance of its rule over cheaper facts
        used = [(x["predicate"], tuple(map(int, x["args"]))) for x in r["premises"]]
        if p == "edge":
            assert r["rule"] == 0 and used == [] and r["cost"] == 0
        elif r["rule"] == 1:
            assert used == [("edge", args)]
        else:
            assert used == [("path", (args[0], used[0][1][1])), ("edge", (used[0][1][1], args[1]))]
        assert r["cost"] == (0 if r["rule"] == 0 else 1 + sum(rows[u]["cost"] for u in used))
    far = max(want, key=lambda k: (want[k], k))
    steps = rules.proof_steps(proofs, proofs.where((F.col("predicate") == "path") & (F.array_join("args", ",") == f"{far[0]},{far[1]}")))
    got = steps.orderBy("depth", "fact").collect()
    assert len(got) == 2 * want[far] and sum(r["rule"] == 0 for r in got) == want[far]
    assert got[0]["fact"] == f"path({far[0]}, {far[1]})" and all((r["because"] is None) == (r["rule"] == 0) for r in got)


# Terms


def robinson(a, b):
    """Most general unifier of two nested tuples (strings are variables), or why there is none."""

    def deref(t, s):
        while isinstance(t, str) and t in s:
            t = s[t]
        return t

    def inside(v, t, s):
        t = deref(t, s)
        return t == v if isinstance(t, str) else any(inside(v, x, s) for x in t[1:])

    def go(x, y, s):
        x, y = deref(x, s), deref(y, s)
        if x == y:
            return s
        if isinstance(x, str) or isinstance(y, str):
            v, t = (x, y) if isinstance(x, str) else (y, x)
            return None if inside(v, t, s) else {**s, v: t}
        if x[0] != y[0] or len(x) != len(y):
            return None
        for p, q in zip(x[1:], y[1:]):
            s = go(p, q, s)
            if s is None:
                return None
        return s

    return go(a, b, {})


def text_of(t):
    return t if isinstance(t, str) else t[0] + (f"({', '.join(map(text_of, t[1:]))})" if len(t) > 1 else "")


def applied(t, s):
    if isinstance(t, str):
        return applied(s[t], s) if t in s else t
    return (t[0], *[applied(x, s) for x in t[1:]])


def variant(a, b, to, back):
    """Equal but for names of variables."""
    if isinstance(a, str) or isinstance(b, str):
        return isinstance(a, str) and isinstance(b, str) and to.setdefault(a, b) == b and back.setdefault(b, a) == a
    return a[0] == b[0] and len(a) == len(b) and all(variant(x, y, to, back) for x, y in zip(a[1:], b[1:]))


def random_term(rnd, depth):
    if depth == 0 or rnd.random() < 0.3:
        return rnd.choice(["X", "Y", "Z", "W", ("a",), ("b",)])
    return rnd.choice([("f", random_term(rnd, depth - 1), random_term(rnd, depth - 1)), ("g", random_term(rnd, depth - 1)), ("f", random_term(rnd, depth - 1))])


def as_term(text):
    root, found = terms.nodes_of(text)

    def build(k):
        name, args = found[k]
        return name if args is None else (name, *[build(x) for x in args])

    return build(root)


def test_unification_equals_robinson(spark):
    rnd = random.Random(8)
    pairs = [(random_term(rnd, 4), random_term(rnd, 4)) for _ in range(120)]
    pairs += [("X", ("f", "X")), (("f", "X", "Y"), ("f", "Y", ("g", "X"))), ("X", "X"), (("a",), ("a",)), (("f", "X", ("a",)), ("f", ("b",), "X"))]
    df = spark.createDataFrame([(i, text_of(a), text_of(b)) for i, (a, b) in enumerate(pairs)], "id long, a string, b string")
    results, bindings = terms.unify(df, "id", "a", "b")
    outcome = {r["pair"]: r["outcome"] for r in results.collect()}
    bound = defaultdict(dict)
    for r in bindings.collect():
        bound[r["pair"]][r["variable"]] = as_term(r["term"])
    kinds = set(outcome.values())
    assert kinds == {"unified", "clash", "occurs"}
    for i, (a, b) in enumerate(pairs):
        want = robinson(a, b)
        assert (outcome[i] == "unified") == (want is not None), (a, b)
        if want is None:
            assert not bound[i]
            continue
        s = bound[i]
        assert all(not (set(_variables(t)) & set(s)) for t in s.values())  # fully applied
        assert applied(a, s) == applied(b, s)
        names = sorted(set(_variables(a)) | set(_variables(b)))
        assert variant(tuple(["v", *[applied(n, s) for n in names]]), tuple(["v", *[applied(n, want) for n in names]]), {}, {})


def _variables(t):
    return [t] if isinstance(t, str) else [v for x in t[1:] for v in _variables(x)]


def test_terms_are_rows_once(spark):
    df = spark.createDataFrame([("f(g(a), g(a), X)",), ("g(a)",), ("f(g(a), g(a), X)",)], "t string")
    assert sorted(r["name"] for r in terms.intern(df, "t").collect()) == ["X", "a", "f", "g"]


@pytest.mark.parametrize("text", ["", "f(", "f(a", "f(a,)", "f(,a)", "a b", "f(a))", "(a)", "f(a)(b)", "f()"])
def test_terms_that_are_none(text):
    with pytest.raises(ValueError):
        terms.nodes_of(text)


# Graphs


def modularity_by_hand(edges, community):
    m = len(edges)
    degree = defaultdict(int)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    inside = sum(community[a] == community[b] for a, b in edges) / m
    whole = defaultdict(int)
    for n, k in degree.items():
        whole[community[n]] += k
    return inside - sum((k / (2 * m)) ** 2 for k in whole.values())


def test_communities_on_levels(spark):
    """Cliques in a ring of rings: one level finds cliques, further levels what they form."""
    rnd = random.Random(2)
    edges = set()
    for c in range(24):
        edges |= {(5 * c + i, 5 * c + j) for i in range(5) for j in range(i + 1, 5)}
        edges.add((5 * c, 5 * ((c + 1) % 24) + 1))
    edges |= {tuple(sorted(rnd.sample(range(120), 2))) for _ in range(12)}
    edges = sorted(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    found, reached = graph_search.communities(df, levels=3)
    got = {r["node"]: r["community"] for r in found.collect()}
    assert set(got) == set(range(120))
    assert reached == sorted(reached) and len(reached) >= 2
    assert abs(modularity_by_hand(edges, got) - reached[-1]) < 1e-9
    one, q = graph_search.moved(graph_search.weighted_links(df), 4)
    assert reached[0] == pytest.approx(q) and reached[-1] >= q


def shares_by_hand(edges):
    """Share of ordered pairs whose shortest paths pass a node, by counting paths between all pairs."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    nodes = sorted(near)
    d, n_paths = {}, {}
    for s in nodes:
        d[s, s], n_paths[s, s], front = 0, 1, [s]
        while front:
            new = []
            for v in front:
                for w in near[v]:
                    if (s, w) not in d:
                        d[s, w], n_paths[s, w] = d[s, v] + 1, 0
                        new.append(w)
                    if d[s, w] == d[s, v] + 1:
                        n_paths[s, w] += n_paths[s, v]
            front = new
    out = {}
    for v in nodes:
        total = sum(n_paths[s, v] * n_paths[v, t] / n_paths[s, t] for s, t in itertools.permutations(nodes, 2) if v not in (s, t) and (s, t) in d and (s, v) in d and (v, t) in d and d[s, v] + d[v, t] == d[s, t])
        out[v] = total / (len(nodes) * (len(nodes) - 1))
    return out


def test_sampled_betweenness_is_within_its_bound(spark):
    rnd = random.Random(9)
    edges = sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(55)} | {(100, 101)})
    want = shares_by_hand(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    for error in (0.05,):
        got, r = graph_search.sampled_betweenness(df, error=error, failure=0.05)
        assert r == math.ceil(math.log(2 * len(want) / 0.05) / (2 * error**2))
        shares = {x["node"]: x["betweenness"] for x in got.collect()}
        assert set(shares) == set(want)
        assert max(abs(shares[v] - want[v]) for v in want) <= error
    assert graph_search.samples_for(0.1, 0.1, 10**9, 20) == graph_search.samples_for(0.1, 0.1, 10, 20)


def test_best_first_equals_all_paths(spark):
    rnd = random.Random(10)
    edges = [(i, rnd.randint(0, 11), rnd.randint(0, 11), rnd.choice([None, 0.9, 0.8, 0.5, 1.0])) for i in range(22)]
    values = {n: f"v{n}" for n in range(0, 12, 3)}
    want = []

    def walk(node, nodes, used, score):
        for i, a, b, c in edges:
            for x, y in {(a, b), (b, a)}:
                if x == node and i not in used and len(used) < 4:
                    s = score * (0.5 if c is None else c)
                    if y in values:
                        want.append((-s, ",".join(map(str, used + [i])), y))
                    walk(y, nodes + [y], used + [i], s)

    walk(0, [0], [], 1.0)
    df = spark.createDataFrame(edges, "id long, src long, dst long, confidence double")
    goals = spark.createDataFrame([(n, values.get(n)) for n in range(12)], "node long, value string")
    for width in (3, 10_000):
        got = graph_search.best_first(df, goals, 0, 4, limit=10, width=width).collect()
        assert sorted((-r["score"], ",".join(map(str, r["edge_ids"])), r["node"]) for r in got) == sorted(set(want))[:10]
        assert all(r["nodes"][-1] == r["node"] and r["value"] == values[r["node"]] for r in got)


# Intervals


def test_touching_intervals(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        s = rnd.randint(-500, 500)
        rows.append((rnd.choice(["a", "b", None]), i, rnd.choice([s, s, s, None]), rnd.choice([s + rnd.choice([0, 1, 3, 40, 700]), s - 1, None])))
    df = spark.createDataFrame(rows, "g string, k long, s long, e long")
    got = [(r["g"], r["a"], r["b"]) for r in intervals.touching_pairs(df, "k", "g", "s", "e").collect()]
    low, high = (lambda x: -(10**18) if x is None else x), (lambda x: 10**18 if x is None else x)
    good = [r for r in rows if r[0] and low(r[2]) <= high(r[3])]
    want = {(x[0], x[1], y[1]) for x, y in itertools.permutations(good, 2) if x[0] == y[0] and x[1] < y[1] and low(x[2]) <= high(y[3]) and low(y[2]) <= high(x[3])}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_group_of_many_intervals(spark):
    """100,000 intervals of one group, each touching two others, and one over all."""
    df = spark.range(100_000).selectExpr("1 AS g", "id AS k", "id * 10 AS s", "id * 10 + 10 AS e").union(spark.range(1).selectExpr("1", "-1L", "0L", "2000000L"))
    got = intervals.touching_pairs(df, "k", "g", "s", "e")
    assert {r["relation"]: r["count"] for r in got.groupBy("relation").count().collect()} == {"MEETS": 99_999, "CONTAINS": 99_999, "STARTED_BY": 1}


def test_rules_in_force(spark):
    events = spark.createDataFrame([("x", 1, 5), ("x", 2, 11), ("y", 3, 5), ("x", 4, None)], "g string, ev long, at long")
    rules_ = spark.createDataFrame([("x", 1, 5, 10), ("x", 2, None, 5), ("x", 3, 6, None), ("x", 4, None, None)], "g string, ru long, s long, e long")
    got = intervals.in_force(events, rules_, ["g"], "ev", "at", "ru", "s", "e")
    assert rows_of(got) == {(1, 1), (1, 2), (1, 4), (2, 3), (2, 4)}


# Vectors


def test_coded_search_is_exact_and_compares_few(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = v.where("vec_id % 50 = 0")
    directions = v.select("vec_id", retrieval.unit(F.col("embedding")).alias("u"))
    codes = vectors.quantised(directions, "vec_id", "u")
    got, compared = vectors.search_quantised(codes, v, asked, "vec_id", "embedding", 10)
    want = retrieval.nearest(v, asked, "vec_id", "embedding", 10)
    assert {(r["query"], r["id"], r["rank"]) for r in got.collect()} == {(r["query"], r["id"], r["rank"]) for r in want.collect()}
    share = compared.agg(F.sum("compared")).first()[0] / (v.count() * asked.count())
    assert share < 0.2


def test_codes_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, -0.5]), (4, [1e-30, 1e30])], "k long, v array<double>")
    got = {r["id"]: (r["scale"], list(r["codes"])) for r in vectors.quantised(v, "k", "v").collect()}
    assert got[1] == (0.0, [0, 0]) and got[3] == (1 / 127, [127, -64]) and got[4][1] == [0, 127] and 2 not in got
    hits, compared = vectors.search_quantised(vectors.quantised(v, "k", "v"), v, v, "k", "v", 2)
    assert {r["query"] for r in hits.collect()} == {1, 3, 4}
