"""Exact quantiles (linear interpolation, as pandas / DuckDB ``quantile_cont``) at scale.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer,
and a global aggregate merges it in one task. Here a sketch brackets each wanted
rank, and passes over the data return counts only: how many values lie below and at
the bracket's ends and middle. The rank then is one of these values, or lies in one
of the open intervals between them, which a sketch of that interval alone brackets
again. Once at most ``FETCH`` values are left in an interval they are fetched. So the
driver receives a fixed number of rows a quantile, however many rows or distinct
values there are, and the answer is exact whatever the sketch does: every pass
excludes at least the values it tested.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.session import materialize

ACCURACY = 10000
FETCH = 1000        # values of one interval that may be brought to the driver


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float],
                    accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """{column: [quantile for q in qs]} over non-null values; None for an empty column."""
    return exact_quantiles_with(df, cols, qs, accuracy)[0]


@dataclass
class _Wanted:
    """The value of one rank of a column; it lies strictly between lo and hi (None: open)."""
    col: str
    rank: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0              # values up to lo, lo included
    size: int = 0               # values strictly between
    probes: list = field(default_factory=list)
    value: float | None = None

    def inside(self):
        x = F.col(self.col).cast("double")
        c = x.isNotNull()
        if self.lo is not None:
            c = c & (x > F.lit(self.lo))
        if self.hi is not None:
            c = c & (x < F.lit(self.hi))
        return c


def exact_quantiles_with(df: DataFrame, cols: list[str], qs: list[float], accuracy: int = ACCURACY,
                         extra_aggs: list | None = None):
    """As ``exact_quantiles``; ``extra_aggs`` ride along in the sketch pass and their
    one-row result is returned second (saves a job for e.g. min/max)."""
    extra_aggs = list(extra_aggs or [])
    if not cols:
        return {}, (df.agg(*extra_aggs).collect()[0] if extra_aggs else None)
    delta = 3.0 / accuracy
    probes = sorted({min(1.0, max(0.0, q + s * delta)) for q in qs for s in (-1, 0, 1)})
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.percentile_approx(x, probes, accuracy).alias(f"p{i}")]
    first = df.agg(*aggs, *extra_aggs).collect()[0]

    wanted: dict[tuple[str, int], _Wanted] = {}
    for i, c in enumerate(cols):
        at = dict(zip(probes, first[f"p{i}"] or []))
        for q in qs if first[f"n{i}"] else []:
            for r in _ranks(first[f"n{i}"], q)[:2]:
                w = wanted.setdefault((c, r), _Wanted(c, r, size=first[f"n{i}"]))
                w.probes = sorted({*w.probes, *(at[min(1.0, max(0.0, q + s * delta))] for s in (-1, 0, 1))})
    while pending := [w for w in wanted.values() if w.value is None]:
        _locate(df, [w for w in pending if w.probes])
        _fetch(df, [w for w in pending if w.value is None and w.size <= FETCH])
        _probe(df, [w for w in pending if w.value is None], accuracy)

    out = {}
    for i, c in enumerate(cols):
        out[c] = []
        for q in qs:
            if not first[f"n{i}"]:
                out[c].append(None)
                continue
            r0, r1, frac = _ranks(first[f"n{i}"], q)
            v0, v1 = wanted[c, r0].value, wanted[c, r1].value
            out[c].append(v0 + (v1 - v0) * frac if frac else v0)
    return out, first


def _ranks(n: int, q: float) -> tuple[int, int, float]:
    pos = q * (n - 1)
    lo = math.floor(pos)
    return lo, min(lo + 1, n - 1), pos - lo


def _locate(df: DataFrame, wanted: list[_Wanted]) -> None:
    """One pass of counts: the rank is one of the probed values, or lies between two of them."""
    if not wanted:
        return
    tests = sorted({(w.col, v) for w in wanted for v in w.probes})
    aggs = []
    for i, (c, v) in enumerate(tests):
        x = F.col(c).cast("double")
        aggs += [F.count_if(x < F.lit(v)).alias(f"lt{i}"), F.count_if(x <= F.lit(v)).alias(f"le{i}")]
    row = df.agg(*aggs).collect()[0]
    counts = {t: (row[f"lt{i}"], row[f"le{i}"]) for i, t in enumerate(tests)}
    for w in wanted:
        above = w.below + w.size      # values below hi
        for v in w.probes:
            lt, le = counts[w.col, v]
            if lt <= w.rank < le:
                w.value = v
            elif le <= w.rank:
                if w.lo is None or v > w.lo:
                    w.lo, w.below = v, le
            elif w.hi is None or v < w.hi:
                w.hi, above = v, lt
        w.size, w.probes = above - w.below, []


def _fetch(df: DataFrame, wanted: list[_Wanted]) -> None:
    """The values of short intervals (at most FETCH each) as (value, count)."""
    if not wanted:
        return
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.when(w.inside(), F.col(w.col).cast("double")).alias("v")) for i, w in enumerate(wanted)])
    rows = (df.select(F.explode(parts).alias("e")).where("e.v IS NOT NULL")
            .groupBy("e.i", "e.v").agg(F.count(F.lit(1)).alias("n")).collect())
    for i, w in enumerate(wanted):
        at = w.below
        for v, n in sorted((r["v"], r["n"]) for r in rows if r["i"] == i):
            at += n
            if w.value is None and w.rank < at:
                w.value = v


def _probe(df: DataFrame, wanted: list[_Wanted], accuracy: int) -> None:
    """Sketches of the open intervals: new values to test around the wanted ranks."""
    if not wanted:
        return
    delta = 3.0 / accuracy
    aggs = []
    for i, w in enumerate(wanted):
        f = (w.rank - w.below) / max(1, w.size - 1)
        ps = [min(1.0, max(0.0, f + s * delta)) for s in (-1, 0, 1)]
        aggs.append(F.percentile_approx(F.when(w.inside(), F.col(w.col).cast("double")), ps, accuracy).alias(f"p{i}"))
    row = df.agg(*aggs).collect()[0]
    for i, w in enumerate(wanted):
        w.probes = sorted(set(row[f"p{i}"]))


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}


GRID = [i / 64 for i in range(65)]      # ranks that a sketch of an open interval brackets


def group_medians(df: DataFrame, group: str, cols: list[str], accuracy: int = ACCURACY, fetch: int = FETCH) -> DataFrame:
    """Exact median of each column per group, as rows (group, i, median), i = column index.

    A table holds, for every (group, column, middle rank), the open interval (lo, hi) in which the
    rank's value lies, the number of values up to lo and of those inside. Where at most ``fetch``
    values are inside, their counted distinct values are read off. Wider intervals are narrowed: a
    sketch (bounded memory, partial aggregation) offers 65 values, one pass counts how many
    values lie below, at and between them, and the interval shrinks to about a 64th. Only counts
    and short lists are ever gathered by group, so a group that holds a third of the rows is like
    any other; every pass excludes the values it tested, so it ends whatever the sketch does.
    """
    parts = [F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]
    long = (df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.explode(F.array(*parts)).alias("e"))
              .select("g", "e.i", "e.v").where(F.col("v").isNotNull()))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2).cast("long"), F.ceil((F.col("n") - 1) / 2).cast("long")))
    none = F.lit(None).cast("double")
    state = materialize(long.groupBy("g", "i").agg(F.count("v").alias("n")).select("g", "i", F.explode(ranks).alias("r"), none.alias("lo"), none.alias("hi"),
                                                                                   F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    done = None
    while True:
        found = _read_off(long, state.where(F.col("inside") <= fetch))
        wide = state.where(F.col("inside") > fetch)
        if not wide.isEmpty():
            narrowed = materialize(_narrowed(long, wide, accuracy))
            found = found.unionByName(narrowed.where("value IS NOT NULL").select("g", "i", "r", "value"))
            state = narrowed.where("value IS NULL").drop("value")
            done = materialize(found) if done is None else done.unionByName(materialize(found))
            continue
        done = found if done is None else done.unionByName(found)
        return done.groupBy("g", "i").agg(F.avg("value").alias("median")).select(F.col("g").alias(group), "i", "median")


def _inside(long: DataFrame, state: DataFrame) -> DataFrame:
    """The values inside the intervals; a row of state each at most, joined by AQE as a broadcast when small."""
    open_ = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    return long.join(state, ["g", "i"]).where(open_)


def _read_off(long: DataFrame, state: DataFrame) -> DataFrame:
    """(g, i, r, value) of intervals with few values."""
    counts = _inside(long, state).groupBy("g", "i", "r", "v").agg(F.count(F.lit(1)).alias("c"), F.first("below").alias("below"))
    lists = counts.groupBy("g", "i", "r").agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("l"), F.first("below").alias("below"))
    at = ("aggregate(l, named_struct('at', below, 'value', CAST(NULL AS DOUBLE)), (s, x) -> named_struct('at', s.at + x.c, "
          "'value', coalesce(s.value, CASE WHEN r < s.at + x.c THEN x.v END))).value")
    return lists.select("g", "i", "r", F.expr(at).alias("value"))


def _narrowed(long: DataFrame, state: DataFrame, accuracy: int) -> DataFrame:
    """The intervals after one sketch and one pass of counts; value where the rank is one of the values tested."""
    keys = ["g", "i", "r"]
    inside = _inside(long, state)
    probes = inside.groupBy(*keys).agg(F.percentile_approx("v", GRID, accuracy).alias("p")).withColumn("p", F.array_sort(F.array_distinct("p")))
    # how many values lie below the first probe, at it, between it and the next, ...: 2 * (probes below) + (1 if at a probe)
    place = F.expr("2 * size(filter(p, x -> x < v)) + CASE WHEN array_contains(p, v) THEN 1 ELSE 0 END")
    counts = inside.join(probes, keys).groupBy(*keys, place.alias("k")).agg(F.count(F.lit(1)).alias("c"))
    lists = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("l"))      # at most 131 counts
    hit = ("aggregate(l, named_struct('at', below, 'k', -1, 'below', below, 'c', 0L), (s, x) -> CASE WHEN s.k < 0 AND r < s.at + x.c "
           "THEN named_struct('at', s.at + x.c, 'k', x.k, 'below', s.at, 'c', x.c) ELSE named_struct('at', s.at + x.c, 'k', s.k, 'below', s.below, 'c', s.c) END)")
    both = state.join(probes, keys).join(lists, keys).withColumn("h", F.expr(hit))
    at_probe = F.expr("h.k % 2 = 1")
    return both.select(*keys, F.expr("CASE WHEN h.k >= 2 THEN p[CAST(h.k DIV 2 AS INT) - 1] ELSE lo END").alias("lo"),
                       F.expr("CASE WHEN CAST(h.k DIV 2 AS INT) < size(p) THEN p[CAST(h.k DIV 2 AS INT)] ELSE hi END").alias("hi"),
                       F.expr("h.below").alias("below"), F.expr("h.c").alias("inside"),
                       F.when(at_probe, F.expr("p[CAST(h.k DIV 2 AS INT)]")).alias("value"))
