"""Rules, truth maintenance and intervals over fact frames.

A relation is a frame with one column per argument. Rules are function-free
(Datalog): compound terms are refused, so the fixpoint is finite.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut


@dataclass(frozen=True)
class Atom:
    predicate: str
    args: tuple

    @property
    def variables(self) -> set[str]:
        return {a for a in self.args if is_variable(a)}


def is_variable(term) -> bool:
    return isinstance(term, str) and re.fullmatch(r"[A-Z]\w*", term) is not None


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]


_ATOM = re.compile(r"\s*(\w+)\s*\(([^()]*)\)\s*")


def parse_atom(text: str) -> Atom:
    """name(arg, ...): names in capitals are variables, all else constants."""
    got = _ATOM.fullmatch(text)
    if not got:
        raise ValueError(f"not a plain atom: {text}")
    return Atom(got[1], tuple(a.strip() for a in got[2].split(",")) if got[2].strip() else ())


def parse_rule(text: str) -> Rule:
    """head(...) :- a(...), b(...)."""
    head, _, body = text.rstrip(". \n").partition(":-")
    atoms = tuple(parse_atom(m[0]) for m in _ATOM.finditer(body))
    rule = Rule(parse_atom(head), atoms)
    if not rule.head.variables <= {v for a in atoms for v in a.variables}:
        raise ValueError(f"head variable without a premise: {text}")
    return rule


def match(relation: DataFrame, atom: Atom) -> DataFrame:
    """Bindings of an atom's variables: constants and repeated variables filter."""
    names = relation.columns
    if len(names) != len(atom.args):
        raise ValueError(f"{atom.predicate} takes {len(names)} arguments")
    first: dict[str, str] = {}
    out = relation
    for column, arg in zip(names, atom.args):
        if not is_variable(arg):
            out = out.where(F.col(column) == arg)
        elif arg in first:
            out = out.where(F.col(column) == F.col(first[arg]))
        else:
            first[arg] = column
    return out.select(*[F.col(c).alias(v) for v, c in first.items()])


def apply_rule(rule: Rule, sources: list[DataFrame]) -> DataFrame:
    """The head's rows from one frame per premise."""
    now = None
    for atom, frame in zip(rule.body, sources):
        part = match(frame, atom)
        if now is None:
            now = part
        else:
            shared = [c for c in part.columns if c in now.columns]
            now = now.join(part, shared) if shared else now.join(part, how="cross")
    return now.select(*[(F.col(a) if is_variable(a) else F.lit(a)).alias(f"a{i}") for i, a in enumerate(rule.head.args)])


def infer(facts: dict[str, DataFrame], rules: list[Rule], rounds: int = 100, goal: Atom | None = None) -> dict[str, DataFrame]:
    """All facts that follow, by semi-naive rounds: each round joins what is new with what is known.

    Stops early when the goal has a match. Raises if rounds are not enough.
    """
    known = {p: cut(f.toDF(*[f"a{i}" for i in range(len(f.columns))]).distinct()) for p, f in facts.items()}
    heads = {r.head.predicate: len(r.head.args) for r in rules}
    spark = next(iter(facts.values())).sparkSession
    for p, n in heads.items():
        if p not in known:
            known[p] = spark.createDataFrame([], ", ".join(f"a{i} string" for i in range(n)))
    new = dict(known)
    for _ in range(rounds):
        made: dict[str, DataFrame] = {}
        for rule in rules:
            for at, atom in enumerate(rule.body):
                if atom.predicate not in new:
                    continue
                got = apply_rule(rule, [new[a.predicate] if i == at else known[a.predicate] for i, a in enumerate(rule.body)])
                p = rule.head.predicate
                made[p] = made[p].union(got) if p in made else got
        new = {}
        for p, rows in made.items():
            fresh = cut(rows.distinct().join(known[p], known[p].columns, "left_anti"))
            if not fresh.isEmpty():
                new[p] = fresh
                known[p] = cut(known[p].union(fresh))
        if not new or (goal and not match(known[goal.predicate], goal).isEmpty()):
            return known
    raise RuntimeError("no fixpoint within the rounds allowed")


def prove(facts: dict[str, DataFrame], rules: list[Rule], goal: Atom, rounds: int = 100) -> DataFrame:
    """Bindings of the goal's variables. Only rules that can reach the goal are run."""
    wanted, relevant = {goal.predicate}, []
    while True:
        more = [r for r in rules if r.head.predicate in wanted and r not in relevant]
        if not more:
            break
        relevant += more
        wanted |= {a.predicate for r in more for a in r.body}
    return match(infer(facts, relevant, rounds)[goal.predicate], goal)


# Truth maintenance


def derived_confidence(justifications: DataFrame, beliefs: DataFrame) -> DataFrame:
    """(fact, confidence): the least confidence of a justification's antecedents, the best justification wins.
    justifications: (fact, justification, antecedent)."""
    j = justifications.join(beliefs.select(F.col("fact").alias("antecedent"), "confidence"), "antecedent")
    one = j.groupBy("fact", "justification").agg(F.min("confidence").alias("confidence"))
    return one.groupBy("fact").agg(F.max("confidence").alias("confidence"))


def contradictions(facts: DataFrame) -> DataFrame:
    """(predicate, key, n): same predicate and leading arguments, different last one.
    facts: (predicate, args) with two arguments or more."""
    lead = F.array_join(F.slice("args", 1, F.size("args") - 1), "|")
    got = facts.where(F.size("args") >= 2).groupBy("predicate", lead.alias("key")).agg(F.count_distinct(F.element_at("args", -1)).alias("n"))
    return got.where("n > 1")


def negated_pairs(facts: DataFrame, prefixes=("not_", "neg_")) -> DataFrame:
    """(predicate, args) that hold together with their negation."""
    pattern = "^(" + "|".join(prefixes) + ")"
    no = facts.where(F.col("predicate").rlike(pattern)).select(F.regexp_replace("predicate", pattern, "").alias("predicate"), "args")
    return facts.join(no, ["predicate", "args"], "left_semi").distinct()


def retract(dependencies: DataFrame, fact, depth: int = 50) -> DataFrame:
    """(node, hops): the fact and all that depends on it, otherwise supported or not.
    dependencies: (antecedent, fact)."""
    from .graph import distances

    start = dependencies.sparkSession.range(1).select(F.lit(fact).alias("node"))
    return distances(dependencies.select(F.col("antecedent").alias("src"), F.col("fact").alias("dst")), start, depth)


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Closed validity; null is unbounded."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at <= end))


def allen(s1: Column, e1: Column, s2: Column, e2: Column, touching: bool = True) -> Column:
    """Allen's relation of two intervals. Without touching, MEETS counts as BEFORE and MET_BY as AFTER."""
    out = F.when(e1 < s2, "BEFORE").when(e2 < s1, "AFTER")
    out = out.when(e1 == s2, "MEETS" if touching else "BEFORE").when(e2 == s1, "MET_BY" if touching else "AFTER")
    out = out.when((s1 == s2) & (e1 == e2), "EQUALS").when(s1 == s2, F.when(e1 < e2, "STARTS").otherwise("STARTED_BY"))
    out = out.when(e1 == e2, F.when(s1 > s2, "FINISHES").otherwise("FINISHED_BY"))
    out = out.when((s1 > s2) & (e1 < e2), "DURING").when((s1 < s2) & (e1 > e2), "CONTAINS")
    return out.when(s1 < s2, "OVERLAPS").otherwise("OVERLAPPED_BY")


def interval_pairs(intervals: DataFrame, key: str, group: str, start: str, end: str, touching: bool = True) -> DataFrame:
    """(group, a, b, relation) of all pairs a < b within a group."""
    a = intervals.select(group, F.col(key).alias("a"), F.col(start).alias("s1"), F.col(end).alias("e1"))
    b = intervals.select(group, F.col(key).alias("b"), F.col(start).alias("s2"), F.col(end).alias("e2"))
    return a.join(b, group).where("a < b").select(group, "a", "b", allen(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"), touching).alias("relation"))


def noisy_or(rows: DataFrame, key: str, p: str) -> DataFrame:
    """1 - product of (1 - p) per key; 1 if any p is 1."""
    inner = F.sum(F.when(F.col(p) < 1, F.log1p(-F.col(p))))
    return rows.groupBy(key).agg(F.when(F.max(p) >= 1, 1.0).otherwise(1 - F.exp(F.coalesce(inner, F.lit(0.0)))).alias("p"))


def confidence_interval(p: Column, level: float) -> tuple[Column, Column]:
    half = (1 - level) / 2
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def resolve(a_conf: Column, b_conf: Column, a_cred: Column, b_cred: Column, a_date: Column, b_date: Column, gap: float = 0.01) -> Column:
    """a, b or unresolved: by confidence, then credibility, then date."""
    out = F.when(a_conf - b_conf > gap, "a").when(b_conf - a_conf > gap, "b")
    out = out.when(a_cred - b_cred > gap, "a").when(b_cred - a_cred > gap, "b")
    return out.when(a_date > b_date, "a").when(b_date > a_date, "b").otherwise("unresolved")


def applicable_rules(rules: DataFrame, facts: DataFrame, terms: str, text: str) -> DataFrame:
    """(rule, fact, score): share of a rule's condition terms that occur as words of the fact's text."""
    r = rules.select("rule", F.size(F.array_distinct(terms)).alias("n"), F.explode(F.array_distinct(terms)).alias("t"))
    f = facts.select("fact", F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("t"))
    return r.join(f, "t").groupBy("rule", "fact", "n").agg(F.count("*").alias("c")).select("rule", "fact", (F.col("c") / F.col("n")).alias("score"))
