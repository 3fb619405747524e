"""Properties from the test strategy: ranges, conservation of counts, partition invariance."""

from pyspark.sql import functions as F

from kohort import config as C
from kohort.checks.compare import rows_key
from kohort.operators import kmeans, stats
from kohort.plans import preprocessing as P
from kohort.plans.queries_cluster import S_COLS, clustered
from kohort.plans.queries_map import risk_map
from kohort.plans.queries_clean import PARAMS
from kohort.sources.tables import raw_screening
from tests.conftest import SF001


def test_scaled_values_in_unit_interval(spark):
    res = clustered(spark, SF001)
    row = res.labelled.agg(*[F.min(c).alias("mn_" + c) for c in S_COLS],
                           *[F.max(c).alias("mx_" + c) for c in S_COLS]).first()
    assert all(row["mn_" + c] >= 0.0 and row["mx_" + c] <= 1.0 for c in S_COLS)


def test_cluster_sizes_sum_to_rows(spark):
    res = clustered(spark, SF001)
    n = res.labelled.count()
    sizes = res.labelled.groupBy("cluster").count().collect()
    assert sum(r["count"] for r in sizes) == n and len(sizes) <= 3


def test_village_counts_add_up(spark):
    rm = risk_map(spark, SF001)
    people = rm.people.count()
    counts = rm.counts.agg(F.sum("total").alias("t"), F.sum(F.col("sehat") + F.col("sedang") + F.col("tinggi")).alias("s")).first()
    assert counts.t == people and counts.s == people
    mapped = rm.mapped.agg(F.sum("total")).first()[0]
    missing = rm.counts.join(rm.mapped.select(F.col("name_norm").alias("desa_norm")), "desa_norm", "left_anti")
    assert mapped <= people and missing.count() >= 0


def test_crosstab_total_row_equals_column_sums(spark):
    res = clustered(spark, SF001)
    ct = stats.crosstab_with_totals(res.labelled, "desa", "cluster", [0, 1, 2]).collect()
    body = [r for r in ct if r.desa != "Total"]
    total = [r for r in ct if r.desa == "Total"][0]
    for c in ("cluster_0", "cluster_1", "cluster_2", "total"):
        assert sum(r[c] for r in body) == total[c]
    assert all(r.cluster_0 + r.cluster_1 + r.cluster_2 == r.total for r in ct)


def test_results_do_not_depend_on_input_partitioning(spark):
    raw = raw_screening(spark, SF001)
    a = P.clean_screening(raw, PARAMS, sort=False).table
    b = P.clean_screening(raw.repartition(13, "nama"), PARAMS, sort=False).table
    assert rows_key([tuple(r) for r in a.collect()], a.columns) == rows_key([tuple(r) for r in b.collect()], b.columns)
    sa, _ = kmeans.scale(a)
    sb, _ = kmeans.scale(b.repartition(3))
    la = kmeans.lloyd(sa, S_COLS).labelled.select("row_id", "cluster")
    lb = kmeans.lloyd(sb, S_COLS).labelled.select("row_id", "cluster")
    assert sorted(map(tuple, la.collect())) == sorted(map(tuple, lb.collect()))


def test_no_python_evaluation_in_core_plans(spark):
    import __spark_entry__ as E
    for name in ("k24_clean_table", "k25_village_risk_map", "a02_descriptive_stats", "f12_group_median_fill"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
