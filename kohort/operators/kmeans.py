"""Clustering operators: min-max scaling (K01), deterministic Lloyd iterations (K03),
K-Means with restarts (K02) and the elbow curve (K04).

Only K x d numbers (centroids) ever reach the driver. Point assignment is a
native expression over centroid literals (no shuffle, no join); centroid
updates are partial-aggregated ``groupBy(cluster)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohort import config as C
from kohort.operators import kmeans_sets
from kohort.operators.missing import add_absent
from kohort.operators.quantiles import exact_quantiles_with
from kohort.session import materialize

SCALED_PREFIX = "s_"


@dataclass
class ScaleModel:
    features: list
    medians: dict
    mins: dict
    maxs: dict


def fit_scaler(df: DataFrame, features: list[str]) -> ScaleModel:
    """K01 fit: exact medians (F07) and min/max per feature, two passes in total
    (min/max ride along in the median sketch pass)."""
    df = add_absent(df, features)
    mm = ([F.min(F.col(f).cast("double")).alias(f"mn_{f}") for f in features] +
          [F.max(F.col(f).cast("double")).alias(f"mx_{f}") for f in features])
    q, row = exact_quantiles_with(df, features, [0.5], extra_aggs=mm)
    medians = {f: q[f][0] for f in features}
    mins, maxs = {}, {}
    for f in features:
        med = medians[f] if medians[f] is not None else 0.0
        medians[f] = med
        # Filling NULLs with the median never moves min/max; an all-NULL column is all 0.
        mins[f] = row[f"mn_{f}"] if row[f"mn_{f}"] is not None else 0.0
        maxs[f] = row[f"mx_{f}"] if row[f"mx_{f}"] is not None else 0.0
    return ScaleModel(list(features), medians, mins, maxs)


def scaled_expr(model: ScaleModel, f: str) -> Column:
    x = F.coalesce(F.col(f).cast("double"), F.lit(float(model.medians[f])))
    rng = float(model.maxs[f]) - float(model.mins[f])
    if rng == 0:
        return F.lit(0.0)   # constant column scales to 0
    return (x - F.lit(float(model.mins[f]))) / F.lit(rng)


def scale(df: DataFrame, features: list[str] = C.FEATURES, model: ScaleModel | None = None,
          prefix: str = SCALED_PREFIX) -> tuple[DataFrame, ScaleModel]:
    """F08 absent features as 0.0 (they stay), F07 median fill, (x-min)/(max-min).

    Scaled features are added as ``prefix + name`` next to the original columns,
    so labels never need a positional re-attach (J08).
    """
    df = add_absent(df, features)
    model = fit_scaler(df, features) if model is None else model
    return df.withColumns({prefix + f: scaled_expr(model, f) for f in features}), model


# --- K03 Lloyd ---------------------------------------------------------------

def _dlit(v: float) -> str:
    """A double literal that parses back to exactly ``v``."""
    return f"CAST({float(v)!r} AS DOUBLE)" if v != v or v in (float("inf"), float("-inf")) else f"{float(v)!r}D"


def distance_sql(cols: list[str], centre: list[float], digits: int | None) -> str:
    terms = " + ".join(f"(`{c}` - {_dlit(v)}) * (`{c}` - {_dlit(v)})" for c, v in zip(cols, centre))
    dist = f"sqrt(0.0D + {terms})"
    return f"round({dist}, {digits})" if digits is not None else dist


def distance_expr(cols: list[str], centre: list[float], digits: int | None) -> Column:
    return F.expr(distance_sql(cols, centre, digits))


def nearest_expr(cols: list[str], centres: list[list[float]], digits: int | None = 4) -> Column:
    """Index of the nearest centre; ties go to the lowest index.

    Built as one SQL expression (one driver call instead of hundreds of Column
    calls); it compiles to the same native arithmetic.
    """
    cand = ", ".join(f"named_struct('d', {distance_sql(cols, c, digits)}, 'k', {j})"
                     for j, c in enumerate(centres))
    return F.expr(f"array_min(array({cand})).k")


@dataclass
class LloydResult:
    labelled: DataFrame          # input rows + ``cluster``
    centres: list                # final centres (K x d), after the last update
    history: list                # centres before each iteration (iteration 0 = initial)
    cols: list


def lloyd(df: DataFrame, cols: list[str], params: C.LloydParams = C.LloydParams(),
          order_col: str = "row_id", persist: bool | str = True) -> LloydResult:
    """Initial centres = first k rows by ``order_col``; each iteration assigns
    (distances rounded, ties -> lowest id) and moves each centre to its members'
    mean (rounded); an empty cluster keeps its centre. ``labelled`` carries the
    assignment made in the last iteration (against the centres it started from).
    """
    pts = materialize(df, "auto" if persist is True else (persist or "none"))
    first = pts.orderBy(F.col(order_col).asc()).limit(params.k).select(*cols).collect()
    centres = [[float(r[c]) for c in cols] for r in first]
    history = [centres]
    labelled = None
    for _ in range(params.iterations):
        labelled = pts.withColumn("cluster", nearest_expr(cols, centres, params.distance_digits))
        means = labelled.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols]).collect()
        new = [list(c) for c in centres]
        for r in means:
            new[r["cluster"]] = [round_half_up(r[c], params.centroid_digits) for c in cols]
        centres = new
        history.append(centres)
    if labelled is None:
        labelled = pts.withColumn("cluster", nearest_expr(cols, centres, params.distance_digits))
    return LloydResult(labelled, centres, history, list(cols))


def round_half_up(v: float, digits: int) -> float:
    """Round as Spark does: half away from zero on the shortest decimal text."""
    from decimal import ROUND_HALF_UP, Decimal
    return float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def centres_frame(spark, centres: list[list[float]], cols: list[str], digits: int = 4) -> DataFrame:
    """Centroid table, one labelled row per cluster (K rows)."""
    rows = [(j, f"Cluster {j}", *[round_half_up(v, digits) for v in c]) for j, c in enumerate(centres)]
    return spark.createDataFrame(rows, ["cluster", "cluster_label", *cols])


# --- K02 / K04: K-Means with restarts (``kmeans_sets``) --------------------------

def kmeans_labels(df: DataFrame, cols: list[str], k: int, params: C.KMeansParams = C.KMeansParams(), id_col: str = "row_id"):
    """(labelled rows, centres, inertia) of the best of ``restarts`` runs."""
    fits = kmeans_sets.fit_sets(df, cols, [k], params, id_col)
    if k not in fits:
        raise ValueError(f"fewer than {k} distinct points")
    return with_label(df, cols, fits[k]), fits[k].centres, fits[k].cost


def with_label(df: DataFrame, cols: list[str], fit: kmeans_sets.Fit, label: str = "cluster") -> DataFrame:
    """df with the cluster of a fit."""
    return df.withColumn(label, F.expr(kmeans_sets.label_sql(cols, fit.centres)))


def total_sum_squares(df: DataFrame, cols: list[str]) -> float:
    """K04 at k=1: inertia of one cluster = sum over features of n * population variance."""
    row = df.agg(*[(F.count(c) * F.var_pop(c)).alias(c) for c in cols]).collect()[0]
    return float(sum(row[c] or 0.0 for c in cols))


def elbow(df: DataFrame, cols: list[str], max_k: int = C.KMeansParams().max_k,
          params: C.KMeansParams = C.KMeansParams(), id_col: str = "row_id") -> list[tuple[int, float]]:
    """Inertia for k = 1..max_k (k clamped to the number of distinct points)."""
    fits = kmeans_sets.fit_sets(df, cols, list(range(2, max_k + 1)), params, id_col)
    return [(1, total_sum_squares(df, cols))] + [(k, f.cost) for k, f in fits.items()]
