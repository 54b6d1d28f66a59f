"""Causal structure: linear structural models, interventions, the PC skeleton."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model: for each variable its parents' weights and its intercept, parents first.
Model = dict[str, tuple[dict[str, float], float]]


def in_order(model: Model) -> list[str]:
    """Variables so that parents come first."""
    out: list[str] = []

    def visit(name: str, above: tuple) -> None:
        if name in above:
            raise ValueError(f"{name} is its own cause")
        for parent in model.get(name, ({}, 0.0))[0]:
            visit(parent, (*above, name))
        if name not in out:
            out.append(name)

    for name in model:
        visit(name, ())
    return out


def _value(model: Model, name: str, of: dict[str, Column]) -> Column:
    weights, intercept = model[name]
    out = F.lit(float(intercept))
    for parent, w in weights.items():
        out = out + w * of.get(parent, F.col(parent))
    return out


def fit(df: DataFrame, parents: dict[str, list[str]]) -> Model:
    """Least squares of each variable on its parents, from one pass of sums; the small systems are solved on the driver."""
    import numpy as np

    names = sorted({*parents, *(p for ps in parents.values() for p in ps)})
    cols = {n: F.col(n).cast("double") for n in names}
    sums = df.dropna(subset=names).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{n}") for n, c in cols.items()], *[F.sum(cols[a] * cols[b]).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]).first()
    pair = lambda a, b: sums[f"p_{min(a, b)}_{max(a, b)}"] or 0.0
    model: Model = {}
    for name, own in parents.items():
        rows = [*own, None]
        total = lambda a, b: (sums["n"] if b is None else sums[f"s_{b}"]) if a is None else (sums[f"s_{a}"] if b is None else pair(a, b))
        x = np.array([[float(total(a, b) or 0.0) for b in rows] for a in rows])
        y = np.array([float(total(a, name) or 0.0) for a in rows])
        w = np.linalg.lstsq(x, y, rcond=None)[0]
        model[name] = (dict(zip(own, map(float, w))), float(w[-1]))
    return model


def predict(df: DataFrame, model: Model, do: dict[str, float] | None = None) -> DataFrame:
    """Adds do_<name> for every variable of the model: its value when those in do are set, noise left out.

    Variables without a mechanism keep the row's value unless they are set.
    """
    of: dict[str, Column] = {k: F.lit(float(v)) for k, v in (do or {}).items()}
    for name in in_order(model):
        if name not in of and name in model:
            of[name] = _value(model, name, of)
    return df.withColumns({f"do_{n}": c for n, c in of.items()})


def counterfactual(df: DataFrame, model: Model, do: dict[str, float]) -> DataFrame:
    """Adds cf_<name>: each row's own noise is kept, then the model is run with do (abduction, action, prediction)."""
    of: dict[str, Column] = {k: F.lit(float(v)) for k, v in do.items()}
    for name in in_order(model):
        if name not in of and name in model:
            noise = F.col(name) - _value(model, name, {})
            of[name] = _value(model, name, of) + noise
    return df.withColumns({f"cf_{n}": c for n, c in of.items()})


def correlations(df: DataFrame, columns: list[str]) -> tuple[int, dict[tuple[str, str], float]]:
    """Rows and the correlation of each pair, in one pass."""
    pairs = list(combinations(columns, 2))
    row = df.dropna(subset=columns).agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    return row["n"], {p: float(row[f"c{i}"] or 0.0) for i, p in enumerate(pairs)}


def _partial(c: dict, a: str, b: str, given: tuple) -> float:
    if not given:
        return c[(a, b)] if (a, b) in c else c[(b, a)]
    *rest, z = given
    ab, az, bz = _partial(c, a, b, tuple(rest)), _partial(c, a, z, tuple(rest)), _partial(c, b, z, tuple(rest))
    down = math.sqrt(max(1e-12, (1 - az * az) * (1 - bz * bz)))
    return (ab - az * bz) / down


def skeleton(df: DataFrame, columns: list[str], critical: float = 1.96, most_given: int = 3) -> dict[tuple[str, str], tuple]:
    """Edges that the PC algorithm leaves, and for each pair apart its separating set.

    One pass gives the correlations of a few columns; conditioning sets grow by
    one among the neighbours that are left (the stable form: neighbours are
    fixed within a size), and a pair goes when Fisher's z of its partial
    correlation is small.
    """
    n, c = correlations(df, columns)
    edges, apart = set(combinations(columns, 2)), {}
    for size in range(most_given + 1):
        near = {v: {x for e in edges if v in e for x in e if x != v} for v in columns}
        for a, b in sorted(edges):
            for given in sorted({g for side in (near[a] - {b}, near[b] - {a}) for g in combinations(sorted(side), size)}):
                r = max(-0.999999, min(0.999999, _partial(c, a, b, given)))
                if abs(math.atanh(r)) * math.sqrt(max(n - size - 3, 1)) <= critical:
                    edges.discard((a, b))
                    apart[(a, b)] = given
                    break
    return {e: None for e in sorted(edges)} | {e: g for e, g in sorted(apart.items())}


def oriented(columns: list[str], found: dict) -> list[tuple[str, str, str]]:
    """(a, b, mark): a -> b where a collider or Meek's first rule says so, else a - b."""
    edges = {e for e, g in found.items() if g is None}
    linked = lambda a, b: (a, b) in edges or (b, a) in edges
    to: set[tuple[str, str]] = set()
    for (a, b), given in found.items():
        if given is not None:
            for z in columns:
                if z not in (a, b) and z not in given and linked(a, z) and linked(b, z):
                    to |= {(a, z), (b, z)}
    changed = True
    while changed:
        changed = False
        for a, z in list(to):
            for b in columns:
                if b not in (a, z) and linked(z, b) and not linked(a, b) and (z, b) not in to and (b, z) not in to:
                    to.add((z, b))
                    changed = True
    out = []
    for a, b in sorted(edges):
        out.append((b, a, "->") if (b, a) in to and (a, b) not in to else (a, b, "->" if (a, b) in to and (b, a) not in to else "-"))
    return out
