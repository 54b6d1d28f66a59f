"""Predicates and validators: each is one boolean or array expression, so it
runs inside the scan's stage and simple parts of it reach the scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = {"$gte": "__ge__", "$lte": "__le__", "$gt": "__gt__", "$lt": "__lt__"}


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def metadata_condition(spec: dict) -> Column:
    """Text and numbers compare, lists are IN, {"$gte": x, ...} are ranges, other
    dicts compare as text, other values are ignored; all combined with AND."""
    out = []
    for name, value in spec.items():
        column = F.col(name)
        if isinstance(value, dict):
            ranges = [getattr(column, op)(value[key]) for key, op in _RANGE.items() if key in value]
            out += ranges or [column == str(value)]
        elif isinstance(value, (list, tuple)):
            out.append(column.isin(*value))
        elif isinstance(value, (str, int, float)):
            out.append(column == value)
    return _all(out)


def search_by_metadata(df: DataFrame, spec: dict, top_k: int, key: str) -> DataFrame:
    """Rows that match, score 1; an empty filter finds nothing."""
    hit = df.where(metadata_condition(spec)) if spec else df.where(F.lit(False))
    return hit.withColumn("score", F.lit(1.0)).orderBy(key).limit(top_k)


@dataclass(frozen=True)
class NodeQuery:
    """A fluent query over a node frame; a tenant must be named before it runs."""

    frame: DataFrame
    conditions: tuple = ()
    columns: tuple = ()
    order: tuple = ()
    n_limit: int | None = None
    n_skip: int = 0
    tenant: str | None = None
    extra: dict = field(default_factory=dict)

    def for_tenant(self, column: str, value) -> "NodeQuery":
        return replace(self, tenant=column, conditions=(*self.conditions, F.col(column) == value))

    def match(self, label: str, column: str = "label") -> "NodeQuery":
        return self.where(F.col(column) == label)

    def where(self, condition: Column) -> "NodeQuery":
        return replace(self, conditions=(*self.conditions, condition))

    def where_exact(self, column: str, value) -> "NodeQuery":
        return self.where(F.col(column) == value)

    def where_contains(self, column: str, text: str) -> "NodeQuery":
        return self.where(F.col(column).contains(text))

    def with_(self, **columns: Column) -> "NodeQuery":
        return replace(self, extra={**self.extra, **columns})

    def return_(self, *columns: str) -> "NodeQuery":
        return replace(self, columns=columns)

    def order_by(self, column: str, descending: bool = False) -> "NodeQuery":
        return replace(self, order=(*self.order, F.desc(column) if descending else F.asc(column)))

    def limit(self, n: int) -> "NodeQuery":
        return replace(self, n_limit=n)

    def skip(self, n: int) -> "NodeQuery":
        return replace(self, n_skip=n)

    def build(self) -> DataFrame:
        if self.tenant is None:
            raise ValueError("a query needs a tenant")
        out = self.frame.withColumns(self.extra) if self.extra else self.frame
        out = out.where(_all(self.conditions))
        out = out.orderBy(*self.order) if self.order else out
        out = out.offset(self.n_skip) if self.n_skip else out
        out = out.limit(self.n_limit) if self.n_limit is not None else out
        return out.select(*self.columns) if self.columns else out


def legal_condition(
    allowed_status=None, min_rank=None, max_rank=None, min_authority=None, need_cited=False, domains=None, start=None, end=None
) -> Column:
    """status, repealed, court_rank (1 is highest), authority, cited_by_higher,
    domain and date; null ranks and domains pass."""
    out = [~F.coalesce("repealed", F.lit(False))]
    if allowed_status:
        out.append(F.col("status").isin(*allowed_status))
    if min_rank is not None:
        out.append(F.col("court_rank").isNull() | (F.col("court_rank") <= min_rank))
    if max_rank is not None:
        out.append(F.col("court_rank").isNull() | (F.col("court_rank") >= max_rank))
    if min_authority is not None:
        out.append(F.col("authority") >= min_authority)
    if need_cited:
        out.append(F.coalesce("cited_by_higher", F.lit(False)))
    if domains:
        out.append(F.col("domain").isNull() | F.col("domain").isin(*domains))
    if start is not None:
        out.append(F.col("date") >= start)
    if end is not None:
        out.append(F.col("date") <= end)
    return _all(out)


def optional_filters(equal: dict, overlap: dict | None = None) -> Column:
    """Equality for each value given, and array overlap for tags."""
    out = [F.col(k) == v for k, v in equal.items() if v is not None]
    out += [F.arrays_overlap(F.col(k), F.array(*[F.lit(x) for x in v])) for k, v in (overlap or {}).items() if v]
    return _all(out)


def active_documents(docs: DataFrame, superseded: DataFrame, labels, term: str, key: str = "id") -> DataFrame:
    """Active, not superseded, with the term in the content; all three for every label."""
    hit = docs.where(F.col("label").isin(*labels) & F.col("active") & F.col("content").contains(term))
    return hit.join(superseded.select(key).distinct(), key, "left_anti")


def validity(repealed: Column, superseded_by: Column, repealed_by: Column, expiry: Column, today) -> tuple[Column, Column]:
    """(valid, reason) by the first rule that fails."""
    reason = (
        F.when(repealed, "repealed").when(superseded_by.isNotNull(), "superseded").when(repealed_by.isNotNull(), "repealed_by").when(expiry < today, "expired").otherwise("valid")
    )
    return reason == "valid", reason


def not_superseded(docs: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """docs with successor (null if none) and valid; edges: (old, new)."""
    return docs.join(edges, F.col(key) == F.col("old"), "left").withColumn("valid", F.col("new").isNull())


def validate_query_text(text: str) -> None:
    """Refuse statements that destroy without a condition."""
    flat = " ".join(text.upper().split())
    if re.search(r"\bDROP\b|\bDELETE ALL\b", flat) or (re.search(r"\b(DETACH )?DELETE\b", flat) and "WHERE" not in flat):
        raise ValueError("destructive statement")


def time_range(df: DataFrame, column: str, start, end, limit: int, key: str) -> DataFrame:
    """Rows of a closed range, newest first."""
    return df.where(F.col(column).between(start, end)).orderBy(F.desc(column), key).limit(limit)


def by_path_confidence(df: DataFrame, hops: str, confidence: str, threshold: float) -> DataFrame:
    """Confidence fades by a tenth per hop; rows under the threshold go."""
    value = F.pow(F.lit(0.9), F.col(hops)) * F.col(confidence)
    return df.withColumn("path_confidence", value).where(F.col("path_confidence") >= threshold)


def feedback(df: DataFrame, start, end, min_rating) -> DataFrame:
    """Closed time range; the floor binds rating rows only, null ratings pass."""
    low = (F.col("kind") == "RATING") & F.col("rating").isNotNull() & (F.col("rating") < min_rating)
    return df.where(F.col("ts").between(start, end) & ~low)


def with_all_tags(df: DataFrame, column: str, tags) -> DataFrame:
    return df.where(_all([F.array_contains(column, t) for t in tags]))


def entity_ok(text: Column, score: Column, label: Column, min_score: float, labels) -> Column:
    return (F.length(F.trim(text)) >= 2) & (score >= min_score) & label.isin(*labels)


def document_problem(text: Column, script: str | None = r"[؀-ۿ]") -> Column:
    """The first rule a text breaks, else null. script: must occur in the first 1000 characters."""
    out = F.when(F.length(text) < 50, "too_short").when(F.length(text) > 1_000_000, "too_long")
    out = out.when(F.size(F.array_remove(F.split(F.trim(text), r"\s+"), "")) < 10, "too_few_words")
    return out.when(~F.substring(text, 1, 1000).rlike(script), "wrong_script") if script else out


def file_problems(path: Column, size: Column, low: int, high: int, suffixes) -> Column:
    """Array of problems of files."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return problems((size < low, "too_small"), (size > high, "too_large"), (~suffix.isin(*suffixes), "suffix"))


def problems(*rules: tuple[Column, str]) -> Column:
    """A chain of rules: the names of all that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def schema_problems(required, types: dict) -> Column:
    """Missing required fields, and fields whose text does not cast to their type."""
    rules = [(F.col(c).isNull(), f"missing:{c}") for c in required]
    rules += [(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull(), f"type:{c}") for c, t in types.items()]
    return problems(*rules)


def content_problems(text: Column, low: int, high: int, script: str, share: float) -> Column:
    n = F.length(text)
    own = n - F.length(F.regexp_replace(text, script, ""))
    return problems((F.trim(text) == "", "blank"), (n < low, "short"), (n > high, "long"), ((n > 0) & (own / n < share), "script_share"))


def quality_score(missing: Column, size: Column) -> Column:
    """1 less .1 per missing field, less .5 if empty or .2 if under 10, held in 0..1."""
    penalty = F.when(size == 0, 0.5).when(size < 10, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.1 * missing - penalty))


def qa_ok(question: Column, answer: Column, source: Column) -> Column:
    return (F.length(F.trim(question)) >= 5) & (F.length(F.trim(answer)) >= 10) & source.isNotNull() & (source != "")


def visible_rows(df: DataFrame, owner: str, user, roles: DataFrame, privileged) -> DataFrame:
    """Own rows, or all rows for users with a privileged role. roles: (user, role)."""
    grants = roles.where((F.col("user") == user) & F.col("role").isin(*privileged)).limit(1).select(F.lit(True).alias("_grant"))
    return df.join(F.broadcast(grants), F.lit(True), "left").where((F.col(owner) == user) | F.col("_grant")).drop("_grant")


def orphans(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that no edge (src, dst) touches."""
    return nodes.join(edges.select(F.col("src").alias(key)), key, "left_anti").join(edges.select(F.col("dst").alias(key)), key, "left_anti")


def integrity_problems(required, dates, now: Column) -> Column:
    """Properties that a node lacks, and dates that lie after now."""
    rules = [(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"missing:{c}") for c in required]
    return problems(*rules, *[(F.col(c) > now, f"future:{c}") for c in dates])


# What counts as sensitive, and the marks of a legal text's parts.
SENSITIVE = (r"\b\d{10}\b", r"\b\d{16}\b", r"\b\d{3}-?\d{2}-?\d{4}\b", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b")
LEGAL_MARKS = {"articles": r"ماده\s+\d+", "clauses": r"بند\s+[الف-ی]", "sections": r"بخش\s+(اول|دوم|سوم|چهارم|پنجم|ششم|هفتم|هشتم|نهم|دهم|[۰-۹]+)", "chapters": r"فصل\s+[۰-۹]+"}


def sensitive_items(text: Column, patterns=SENSITIVE) -> Column:
    """Number of pieces of text that look sensitive, by any pattern; a piece counts for each pattern it fits."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for p in patterns])


def legal_structure(text: Column, marks: dict = LEGAL_MARKS) -> dict[str, Column]:
    """Counts of the marks of a legal text's parts, and `warnings` for those it should have."""
    counts = {name: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for name, p in marks.items()}
    return counts | {"warnings": problems(*[(counts[c] == 0, f"no_{c}") for c in ("articles", "clauses") if c in counts])}


def contains_any(df: DataFrame, term: str, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).contains(term) for c in columns])).withColumn("score", F.lit(1.0))
