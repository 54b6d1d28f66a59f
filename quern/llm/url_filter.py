"""URL filters: longest-match host and path rules, then gradient-boosted trees
on lexical features.

The trees are trained from labelled URLs: those that a rule decides, in a
bounded sample spread by a hash of the URL. Features are expressions over the
URL: length, depth, digit ratio, entropy, parameter counts, and how frequent and
how often blocked the last label of its host and the last two are, out of fold.
Training and scoring stay in the JVM.

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule, and is left to the trees like any other; ties between rules of equal
length go to the longer host; repeated rows get equal verdicts; where there is
nothing to learn from (no labelled URL, or one class) the verdict is the only
class seen, else allow; an empty table gives no rows; URLs of any length are
judged whole; further columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, ascii_lower, named

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Labelled URLs to learn from, at most about so many.
TRAIN_URLS = 20_000
TREES, DEPTH, LEAF_URLS = 12, 3, 20
#: Suffix statistics of a training row come from the rows of the other folds.
FOLDS = 5
SLICES = 1 << 30


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def decided(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, host_size, rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for verdict, h, p in rules:
        on_host = (host == h) | host.endswith("." + h)
        found = F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on_host & path.startswith(p), found))
    return F.array_max(F.array(*fits))


def _share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def _entropy(text: Column) -> Column:
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    used = F.filter(shares, lambda p: p > 0)
    return F.when(n > 0, F.aggregate(used, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features; suffix statistics are joined on later."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "url_len": F.length(u).cast("double"),
        "host_len": F.length(host).cast("double"),
        "path_len": F.length(path).cast("double"),
        "path_depth": F.size(F.array_remove(F.split(path, "/"), "")).cast("double"),
        "host_labels": F.size(F.array_remove(F.split(host, r"\."), "")).cast("double"),
        "digit_ratio": _share(u, "[0-9]+"),
        "upper_ratio": _share(u, "[A-Z]+"),
        "mark_ratio": _share(u, "[A-Za-z0-9]+"),
        "entropy": _entropy(u),
        "n_params": F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0).cast("double"),
        "has_fragment": u.contains("#").cast("double"),
        "secure": u.startswith("https").cast("double"),
    }


SUFFIX_FEATURES = ("tld_share", "tld_blocked", "domain_share", "domain_blocked")


def suffixes_of(host: Column) -> tuple[Column, Column]:
    """The last label of a host, and the last two."""
    return F.regexp_extract(host, r"[^.]*$", 0), F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0)


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(23), url), F.lit(FOLDS)).cast("int")


@dataclass
class Trees:
    """Fitted trees with the suffix statistics of their sample: (level, suffix, n, b, n_folds, b_folds)."""

    model: object
    suffixes: DataFrame
    total: int
    prior: float


def _with_features(df: DataFrame, suffixes: DataFrame, total: int, prior: float, out_of_fold: bool) -> DataFrame:
    """df(url, host, path) with a vector of features.

    Rows that the statistics were made of get them out of fold: from the other
    folds' rows only, so that a row's label is not in its own features.
    """
    from pyspark.ml.feature import VectorAssembler

    columns = features(F.col("url"), F.col("host"), F.col("path"))
    df = df.withColumns({f"f_{k}": c for k, c in columns.items()} | {"fold": fold_of(F.col("url"))})
    for level, (name, key) in enumerate(zip(("tld", "domain"), suffixes_of(F.col("host")))):
        # as many rows as the bounded sample has suffixes
        own = suffixes.where(F.col("level") == level).select(F.col("suffix").alias("own_suffix"), "n", "b", "n_folds", "b_folds")
        df = df.withColumn("suffix", key).join(F.broadcast(own), F.col("suffix") == F.col("own_suffix"), "left")
        n, b = F.coalesce("n", F.lit(0)), F.coalesce("b", F.lit(0.0))
        if out_of_fold:
            n, b = n - F.coalesce(F.col("n_folds")[F.col("fold")], F.lit(0)), b - F.coalesce(F.col("b_folds")[F.col("fold")], F.lit(0.0))
        df = df.withColumns({f"f_{name}_share": n / total, f"f_{name}_blocked": (b + 5 * prior) / (n + 5)}).drop("suffix", "own_suffix", "n", "b", "n_folds", "b_folds")
    return VectorAssembler(inputCols=[f"f_{k}" for k in (*columns, *SUFFIX_FEATURES)], outputCol="features").transform(df)


def learn(labelled: DataFrame, train_urls: int = TRAIN_URLS) -> Trees | float:
    """Trees from rows (url, host, path, label 0 or 1), or the only label there is (0 if there is none)."""
    from pyspark.ml.classification import GBTClassifier

    stats = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(stats) < 2:
        return max(stats, default=0.0)
    share = min(1.0, train_urls / sum(stats.values()))
    steps = Steps(labelled.sparkSession)
    sample = steps.stored(labelled.where(F.pmod(F.xxhash64(F.lit(17), "url"), F.lit(SLICES)) < int(share * SLICES)), "url-sample")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return max(counts, default=max(stats, key=stats.get))
    total = sum(counts.values())
    prior = counts[1.0] / total
    keyed = sample.select("label", fold_of(F.col("url")).alias("fold"), F.posexplode(F.array(*suffixes_of(F.col("host")))).alias("level", "suffix"))
    by_fold = lambda value: F.array(*[F.sum(F.when(F.col("fold") == f, value).otherwise(F.lit(0))) for f in range(FOLDS)])
    suffixes = keyed.groupBy("level", "suffix").agg(F.count("*").alias("n"), F.sum("label").alias("b"), by_fold(F.lit(1)).alias("n_folds"), by_fold(F.col("label")).alias("b_folds"))
    suffixes = steps.stored(suffixes, "suffixes")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.2, minInstancesPerNode=LEAF_URLS, seed=7)
    return Trees(trees.fit(_with_features(sample, suffixes, total, prior, True).select("features", "label")), suffixes, total, prior)


def scored(df: DataFrame, trees: Trees | float) -> DataFrame:
    """df(key, url, host, path, ...) with block_score."""
    from pyspark.ml.functions import vector_to_array

    if not isinstance(trees, Trees):
        return df.withColumn("block_score", F.lit(float(trees)))
    made = _with_features(df, trees.suffixes, trees.total, trees.prior, False)
    return trees.model.transform(made).select(*df.columns, vector_to_array("probability")[1].alias("block_score"))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """(own, url, host, path, ruling): own holds all columns of pages, so that their names clash with none."""
    url = F.col("url").cast("string")
    rows = pages.select(F.struct(*[named(c).alias(c) for c in pages.columns]).alias("own"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.withColumn("ruling", decided(F.col("host"), F.col("path"), rules))


def labelled(rows: DataFrame) -> DataFrame:
    """The URLs that a rule decides, labelled 1 where it blocks them."""
    return rows.where(F.col("ruling").isNotNull()).select("url", "host", "path", (F.col("ruling.verdict") == "block").cast("double").alias("label"))


def judge(pages: DataFrame, rules=RULES, train_urls: int = TRAIN_URLS) -> DataFrame:
    """All columns of pages with host, path, rule, verdict and block_score (null
    where a rule decided), which replace columns of these names."""
    rows = ruled(pages, rules)
    out = scored(rows, learn(labelled(rows), train_urls))
    keep = [F.col("own")[c].alias(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "block_score")]
    verdict = F.coalesce("ruling.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return out.select(*keep, "host", "path", F.col("ruling.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("ruling").isNull(), F.col("block_score")).alias("block_score"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


#: What SQL can express of the result: all but the verdict of the trees.
RULE_SQL = """
WITH h AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(verdict, length(r.h || r.p)) AS ruled
      FROM p JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, f.ruled FROM p LEFT JOIN f USING (page_id)
"""
