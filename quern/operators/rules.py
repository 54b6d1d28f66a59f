"""Rule models kept between runs, and why their facts hold.

`RuleMemory` stores a model as written relations and keeps it true under
batches of inserted and deleted facts: deletions by delete-and-rederive
(A. Gupta, I. Mumick, V. Subrahmanian, Maintaining views incrementally, 1993),
insertions by semi-naive rounds that start from what is new. `derivations`
keeps for every fact of a model one cheapest proof, `proof_steps` unfolds it.

At size: every join of a round starts from the delta, which is broadcast while
its counted rows are few and shuffled beyond that; stored relations are scanned,
never rewritten, until the batches written since the last rewrite hold as many
rows as what they changed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stored
from .logic import Atom, Rule, is_variable, match

#: Deltas of so few rows are broadcast: a row of ten arguments of 50 bytes takes half a kilobyte, so 50 MB at most.
BROADCAST_ROWS = 100_000


def columns_of(n: int) -> list[str]:
    return [f"a{i}" for i in range(n)]


class Counted:
    """A written frame with its number of rows."""

    def __init__(self, df: DataFrame):
        self.df = stored(df)
        self.rows = self.df.count()

    @property
    def small(self) -> DataFrame:
        return F.broadcast(self.df) if self.rows <= BROADCAST_ROWS else self.df


def join_premises(premises: list[tuple[Atom, DataFrame]]) -> DataFrame:
    """Bindings of all variables; premises are taken in an order in which each shares a variable with those
    before it, as far as there is one, beginning with the first."""
    todo = list(premises)
    atom, frame = todo.pop(0)
    now = match(frame, atom)
    while todo:
        at = next((i for i, (a, _) in enumerate(todo) if a.variables & set(now.columns)), 0)
        atom, frame = todo.pop(at)
        part = match(frame, atom)
        shared = [c for c in part.columns if c in now.columns]
        if part.columns:
            now = now.join(part, shared) if shared else now.join(part, how="cross")
        else:  # no variables: it holds or it does not
            now = now.join(part.limit(1), how="cross")
    return now


def head_rows(rule: Rule, bindings: DataFrame) -> DataFrame:
    return bindings.select(*[(F.col(a) if is_variable(a) else F.lit(a)).alias(f"a{i}") for i, a in enumerate(rule.head.args)])


def consequences(rules: list[Rule], delta: dict[str, Counted], known) -> dict[str, DataFrame]:
    """Heads of rule instances with a premise in the delta and the others in known(predicate)."""
    made: dict[str, DataFrame] = {}
    for rule in rules:
        for at, atom in enumerate(rule.body):
            if atom.predicate not in delta:
                continue
            others = [(a, known(a.predicate)) for i, a in enumerate(rule.body) if i != at]
            got = head_rows(rule, join_premises([(atom, delta[atom.predicate].small), *others]))
            p = rule.head.predicate
            made[p] = made[p].union(got) if p in made else got
    return made


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, rows.columns, "left_anti")


class RuleMemory:
    """A model of rules over stored relations, in a folder that all executors reach.

    Each batch adds written parts: for a relation, rows that came and rows that
    went. A relation is its parts in order, so a batch writes no more than it
    changes. The list of parts is a line of JSON per batch, written last: a
    batch that was cut short never happened.
    """

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule], schemas: dict[str, str]):
        """schemas: for each predicate its arguments' types, like "long, string"."""
        self.spark, self.path, self.rules, self.log = spark, path, rules, []
        self.types = {p: [t.strip() for t in s.split(",")] for p, s in schemas.items()}
        for p in {a.predicate for r in rules for a in (r.head, *r.body)}:
            if p not in self.types:
                raise ValueError(f"no schema for {p}")
        self.parts: list[dict] = []
        if self._exists(f"{path}/batches"):
            lines = [r["value"] for r in spark.read.text(f"{path}/batches").collect()]  # a line for each batch
            for line in sorted((json.loads(x) for x in lines), key=lambda b: b["batch"]):
                self.parts = line["parts"] if line["whole"] else self.parts + line["parts"]
                self.batch = line["batch"] + 1
        else:
            self.batch = 0

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _schema(self, predicate: str) -> str:
        return ", ".join(f"a{i} {t}" for i, t in enumerate(self.types[predicate]))

    def _empty(self, predicate: str) -> DataFrame:
        return self.spark.createDataFrame([], self._schema(predicate))

    def relation(self, predicate: str, kind: str = "model") -> DataFrame:
        """All facts of a predicate; kind "base" gives only those asserted."""
        now = None
        for part in self.parts:
            if part["predicate"] == predicate and part["kind"] == kind:
                rows = self.spark.read.schema(self._schema(predicate)).parquet(f"{self.path}/{part['folder']}")
                if part["came"]:
                    now = rows if now is None else now.union(rows)
                else:
                    now = without(now, F.broadcast(rows) if part["rows"] <= BROADCAST_ROWS else rows)
        return self._empty(predicate) if now is None else now

    def _named(self, predicate: str, rows: DataFrame) -> DataFrame:
        types = self.types[predicate]
        return rows.toDF(*columns_of(len(types))).select(*[F.col(f"a{i}").cast(t).alias(f"a{i}") for i, t in enumerate(types)]).distinct()

    def _rounds(self, phase: str, seeds: dict[str, DataFrame], known, keep) -> dict[str, Counted]:
        """What follows from the seeds by rounds; keep(predicate, rows, so far) leaves the rows that count as new."""
        total: dict[str, list[Counted]] = {}
        so_far = lambda p: [c.df for c in total.get(p, [])]
        made = seeds
        while made:
            new = {}
            for p, rows in made.items():
                got = Counted(keep(p, rows.distinct(), so_far(p)))
                if got.rows:
                    new[p] = got
                    self.log.append((self.batch, phase, p, got.rows))
            for p, got in new.items():
                total.setdefault(p, []).append(got)
            made = consequences(self.rules, new, lambda p: known(p, so_far(p)))
        out = {}
        for p, frames in total.items():
            rows = frames[0].df
            for more in frames[1:]:
                rows = rows.union(more.df)
            out[p] = Counted(rows) if len(frames) > 1 else frames[0]
        return out

    def apply(self, inserts: dict[str, DataFrame] | None = None, deletes: dict[str, DataFrame] | None = None) -> dict[str, tuple[int, int]]:
        """Make a batch part of the model; (came, went) for each predicate that changed.

        A fact both deleted and inserted is there afterwards.
        """
        inserts = {p: self._named(p, r) for p, r in (inserts or {}).items()}
        deletes = {p: self._named(p, r) for p, r in (deletes or {}).items()}
        base_came = {p: Counted(without(r, self.relation(p, "base"))) for p, r in inserts.items()}
        base_went = {p: Counted((without(r, inserts[p]) if p in inserts else r).join(self.relation(p, "base"), r.columns, "left_semi")) for p, r in deletes.items()}

        def both(rows: DataFrame, more: list[DataFrame]) -> DataFrame:
            for df in more:
                rows = rows.union(df)
            return rows

        def minus(rows: DataFrame, gone: list[DataFrame]) -> DataFrame:
            for df in gone:
                rows = without(rows, df)
            return rows

        # all that rests on what is deleted, otherwise supported or not
        doubtful = self._rounds("doubt", {p: c.df for p, c in base_went.items()}, lambda p, _: self.relation(p), lambda p, rows, so_far: minus(rows.join(self.relation(p), rows.columns, "left_semi"), so_far))
        left = {p: without(self.relation(p), c.small) for p, c in doubtful.items()}
        certain = lambda p: left[p] if p in left else self.relation(p)
        seeds = {p: c.df for p, c in base_came.items()}

        def seed(p: str, rows: DataFrame) -> None:
            seeds[p] = seeds[p].union(rows) if p in seeds else rows

        for p, c in doubtful.items():
            asserted = self.relation(p, "base")
            asserted = without(asserted, base_went[p].small) if p in base_went else asserted
            seed(p, c.df.join(asserted, c.df.columns, "left_semi"))
        for rule in self.rules:
            p = rule.head.predicate
            if p in doubtful:  # a doubtful fact with a proof from certain ones
                seed(p, head_rows(rule, join_premises([(rule.head, doubtful[p].small), *[(a, certain(a.predicate)) for a in rule.body]])))
        came = self._rounds("add", seeds, lambda p, so_far: both(certain(p), so_far), lambda p, rows, so_far: minus(without(rows, certain(p)), so_far))

        parts, changed = [], {}
        for p in sorted({*came, *doubtful, *base_came, *base_went}):
            new = Counted(without(came[p].df, doubtful[p].df)) if p in came and p in doubtful else came.get(p)
            gone = Counted(without(doubtful[p].df, came[p].df)) if p in came and p in doubtful else doubtful.get(p)
            changed[p] = (new.rows if new else 0, gone.rows if gone else 0)
            for kind, rows, here in (("model", gone, False), ("model", new, True), ("base", base_went.get(p), False), ("base", base_came.get(p), True)):
                if rows and rows.rows:
                    folder = f"parts/{self.batch}-{kind}-{p}-{'came' if here else 'went'}"
                    rows.df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
                    parts.append({"predicate": p, "kind": kind, "came": here, "rows": rows.rows, "folder": folder})
        self._commit(parts, whole=False)
        self._rewrite_if_due()
        return {p: c for p, c in changed.items() if c != (0, 0)}

    def _commit(self, parts: list[dict], whole: bool) -> None:
        line = json.dumps({"batch": self.batch, "whole": whole, "parts": parts})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/batches")
        self.parts = parts if whole else self.parts + parts
        self.batch += 1

    def _rewrite_if_due(self) -> None:
        """One part for each relation once later parts hold as many rows as the first, or are very many."""
        groups: dict[tuple, list[dict]] = {}
        for part in self.parts:
            groups.setdefault((part["predicate"], part["kind"]), []).append(part)
        due = {k for k, g in groups.items() if len(g) > 1 and (sum(x["rows"] for x in g[1:]) > g[0]["rows"] or len(g) > 32)}
        if not due:
            return
        parts = [x for k, g in groups.items() if k not in due for x in g]
        for p, kind in sorted(due):
            folder = f"parts/{self.batch}-{kind}-{p}-whole"
            self.relation(p, kind).write.mode("overwrite").parquet(f"{self.path}/{folder}")
            rows = self.spark.read.schema(self._schema(p)).parquet(f"{self.path}/{folder}").count()
            parts.append({"predicate": p, "kind": kind, "came": True, "rows": rows, "folder": folder})
        self._commit(parts, whole=True)


# Why a fact holds


def _args(atom: Atom) -> Column:
    return F.array(*[(F.col(a) if is_variable(a) else F.lit(a)).cast("string") for a in atom.args])


def derivations(facts: dict[str, DataFrame], rules: list[Rule], rounds: int = 1000) -> DataFrame:
    """(predicate, args, cost, rule, premises): one cheapest proof for each fact of the model.

    Given facts cost nothing and have rule 0; an instance of a rule (numbered
    from 1) costs one more than its premises together. Of equally cheap proofs
    the first rule, then the least premises count. Costs fall from round to
    round and only facts whose cost fell are joined again, so the rounds end;
    premises are always cheaper than what they prove, so proofs have no circle.
    args and premises are strings.
    """
    spark = next(iter(facts.values())).sparkSession
    arity = {p: len(f.columns) for p, f in facts.items()} | {r.head.predicate: len(r.head.args) for r in rules}
    fields = "cost long, rule int, premises array<struct<predicate:string,args:array<string>>>"
    given = F.from_json(F.lit("[]"), "array<struct<predicate:string,args:array<string>>>")

    def typed(p: str, rows: DataFrame) -> DataFrame:
        return rows.toDF(*columns_of(arity[p])).distinct().select("*", F.lit(0).cast("long").alias("cost"), F.lit(0).alias("rule"), given.alias("premises"))

    best = {p: stored(typed(p, f)) for p, f in facts.items()}
    for p, n in arity.items():
        if p not in best:
            best[p] = spark.createDataFrame([], ", ".join([*(f"a{i} string" for i in range(n)), fields]))
    new = dict(best)
    for _ in range(rounds):
        made: dict[str, DataFrame] = {}
        for number, rule in enumerate(rules, 1):
            p = rule.head.predicate
            for at, atom in enumerate(rule.body):
                if atom.predicate not in new:
                    continue
                got = None
                order = [at, *[i for i in range(len(rule.body)) if i != at]]
                while order:
                    here = next((i for i in order if got is None or rule.body[i].variables & set(got.columns)), order[0])
                    order.remove(here)
                    source = (new if here == at else best)[rule.body[here].predicate]
                    n = len(rule.body[here].args)
                    part = match(source.select(*columns_of(n), F.col("cost").alias(f"cost_{here}")), Atom(rule.body[here].predicate, (*rule.body[here].args, f"Cost_{here}")))
                    shared = [] if got is None else [c for c in part.columns if c in got.columns]
                    got = part if got is None else got.join(part, shared) if shared else got.join(part, how="cross")
                cost = sum((F.col(f"Cost_{i}") for i in range(len(rule.body))), F.lit(1)).cast("long")
                used = F.array(*[F.struct(F.lit(a.predicate).alias("predicate"), _args(a).alias("args")) for a in rule.body])
                heads = [(F.col(a) if is_variable(a) else F.lit(a)).alias(f"a{i}") for i, a in enumerate(rule.head.args)]
                rows = got.select(*heads, cost.alias("cost"), F.lit(number).alias("rule"), used.alias("premises"))
                made[p] = made[p].union(rows) if p in made else rows
        new = {}
        for p, rows in made.items():
            keys = columns_of(arity[p])
            least = rows.groupBy(*keys).agg(F.min(F.struct("cost", "rule", "premises")).alias("x")).select(*keys, "x.*")
            old = best[p].select(*keys, F.struct("cost", "rule", "premises").alias("known"))
            better = stored(least.join(old, keys, "left").where(F.col("known").isNull() | (F.struct("cost", "rule", "premises") < F.col("known"))).drop("known"))
            if not better.isEmpty():
                new[p] = better
                best[p] = stored(without_keys(best[p], better, keys).unionByName(better))
        if not new:
            break
    else:
        raise RuntimeError("no fixpoint within the rounds allowed")
    out = None
    for p, n in sorted(arity.items()):
        rows = best[p].select(F.lit(p).alias("predicate"), F.array(*[F.col(c).cast("string") for c in columns_of(n)]).alias("args"), "cost", "rule", "premises")
        out = rows if out is None else out.unionByName(rows)
    return out


def without_keys(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(other.select(*keys), keys, "left_anti")


def fact_text(predicate: Column, args: Column) -> Column:
    return F.concat(predicate, F.lit("("), F.array_join(args, ", "), F.lit(")"))


def proof_steps(proofs: DataFrame, goals: DataFrame, depth: int = 1000) -> DataFrame:
    """(goal, depth, fact, rule, because): the proof of every goal (predicate, args), unfolded to given facts.

    A fact that a proof uses twice appears once, at its least depth; `because`
    names its premises, null for given facts.
    """
    p = proofs.select(F.col("predicate").alias("p"), F.col("args").alias("a"), "rule", "premises")
    front = goals.select(fact_text(F.col("predicate"), F.col("args")).alias("goal"), "predicate", "args").distinct()
    seen = None
    for level in range(depth):
        here = stored(front.join(p, (F.col("predicate") == F.col("p")) & (F.col("args") == F.col("a"))).select("goal", "predicate", "args", "rule", "premises", F.lit(level).alias("depth")))
        if here.isEmpty():
            break
        seen = here if seen is None else seen.unionByName(here)
        more = here.select("goal", F.explode("premises").alias("x")).select("goal", "x.predicate", "x.args").distinct()
        front = without_keys(more, seen, ["goal", "predicate", "args"])
    if seen is None:
        return proofs.sparkSession.createDataFrame([], "goal string, depth int, fact string, rule int, because string")
    because = F.array_join(F.transform("premises", lambda x: fact_text(x["predicate"], x["args"])), " and ")
    return seen.select("goal", "depth", fact_text(F.col("predicate"), F.col("args")).alias("fact"), "rule", F.when(F.size("premises") > 0, because).alias("because"))
