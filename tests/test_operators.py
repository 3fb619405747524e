"""DataFrame operators against closed forms and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort import config as C
from kohort.operators import kmeans, metrics, missing, pca, ranking, stats
from kohort.operators.dedup import first_per_key
from kohort.operators.quantiles import exact_quantiles


def test_f02_first_per_key_collapses_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "b")], "row_id long, nik string")
    assert sorted(r.row_id for r in first_per_key(df, "nik").collect()) == [1, 2, 5]


def test_f04_f05_thresholds_are_strict(spark):
    rows = [(None, 1.0)] * 7 + [(1.0, 1.0)] * 3      # 70 % null -> kept
    df = spark.createDataFrame(rows, "a double, b double")
    assert missing.sparse_columns(df, ["a", "b"], 0.7) == []
    df2 = spark.createDataFrame([(None, 1.0), (1.0, 1.0)], "a double, b double")   # 50 % null row kept
    assert missing.drop_sparse_rows(df2, ["a", "b"], 0.5).count() == 2


def test_f07_median_fill(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    out = missing.median_fill(df, ["a", "b"]).collect()
    assert [r.a for r in out] == [1.0, 2.5, 4.0] and [r.b for r in out] == [0.0, 0.0, 0.0]


def test_f09_iqr(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "x double")
    assert [r.x_outlier for r in missing.iqr_outlier_flags(df, ["x"]).collect()] == [False] * 4 + [True]


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 25000])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = np.round(rng.normal(100, 20, n), 1)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], accuracy=100)["x"]
    assert np.allclose(got, np.quantile(vals, [0.25, 0.5, 0.75]), rtol=0, atol=1e-9)


def test_f12_group_median(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("A", None), ("B", None), ("B", None), ("C", 10.0)],
                               "desa string, x double")
    out = {(r.desa, i): r.x for i, r in enumerate(missing.group_median_fill(df, ["x"]).orderBy("desa").collect())}
    vals = [v for _, v in sorted(out.items(), key=lambda t: t[0][1])]
    assert vals == [1.0, 3.0, 2.0, 3.0, 3.0, 10.0]


def test_a13_constant_histogram(spark):
    df = spark.createDataFrame([(5.0,)] * 10, "x double")
    rows = stats.histogram(df, "x", 20).collect()
    rows.sort(key=lambda r: r["bin"])
    assert [(r["bin"], r["count"]) for r in rows] == [(i, 10 * (i == 10)) for i in range(20)] and rows[10]["lo"] == 5.0


def test_k01_scaling(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (5.0, 7.0)], "a double, c double")
    out, _ = kmeans.scale(df, ["a", "c"])
    assert [(r.s_a, r.s_c) for r in out.collect()] == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


def test_k07_silhouette_line(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 0), (3, 10.0, 1)], "id long, x double, cluster int")
    pts = metrics.silhouette_points(df, metrics.as_vector(["x"]), "id")
    got = {r.id: round(r.silhouette, 4) for r in pts.collect()}
    assert got == {1: 0.9, 2: 0.8889, 3: 0.0}
    pts1 = metrics.silhouette_points(df, metrics.as_vector(["x"]), "id", singleton=1.0)
    assert {r.id: r.silhouette for r in pts1.collect()}[3] == 1.0


def test_silhouette_blocks_agree(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(300, 3)) + np.repeat(np.eye(3) * 4, 100, axis=0)
    lab = np.repeat([0, 1, 2], 100)
    df = spark.createDataFrame([(i, [float(v) for v in p], int(k)) for i, (p, k) in enumerate(zip(pts, lab))],
                               "id long, v array<double>, cluster int")
    small = metrics.silhouette_mean(metrics.silhouette_points(df, F.col("v"), "id", block_rows=37))
    one = metrics.silhouette_mean(metrics.silhouette_points(df, F.col("v"), "id", block_rows=10_000))
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(pts)):
        a = d[i, lab == lab[i]].sum() / (np.sum(lab == lab[i]) - 1)
        b = min(d[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(small - np.mean(s)) < 1e-9 and abs(one - np.mean(s)) < 1e-9


def test_k08_k09_k10_closed_forms(spark):
    df = spark.createDataFrame([(0.0, 0), (2.0, 0), (10.0, 1), (12.0, 1)], "x double, cluster int")
    st = metrics.cluster_stats(df, metrics.as_vector(["x"]))
    assert metrics.davies_bouldin(st) == pytest.approx(0.2)
    assert metrics.calinski_harabasz(st) == pytest.approx(50.0)
    assert metrics.inertia(st) == pytest.approx(4.0)


def test_w02_rank(spark):
    means = spark.createDataFrame([(0, 70.0), (1, 70.0), (2, 65.0)], "cluster int, umur double")
    got = {r.cluster: r.risk_label for r in ranking.rank_clusters(means).collect()}
    # scores 1.5, 1.5, 1.0 -> cluster 2 lowest, cluster 1 highest (tie broken by id)
    assert got == {2: "RELATIF SEHAT", 0: "RISIKO SEDANG", 1: "RISIKO TINGGI"}
    single = spark.createDataFrame([(0, 50.0)], "cluster int, umur double")
    assert ranking.rank_clusters(single).first().risk_label == "RISIKO TINGGI"


def test_j03_percentages(spark):
    from kohort.operators.villages import percentages
    df = spark.createDataFrame([(1, 1, 1, 3), (0, 0, 0, 0)], "sehat long, sedang long, tinggi long, total long")
    rows = percentages(df).collect()
    assert (rows[0].pct_sehat, rows[0].pct_risiko) == (33.3, 66.7)
    assert (rows[1].pct_sehat, rows[1].pct_risiko) == (0.0, 0.0)


def test_lloyd_monotone_inertia(spark):
    rng = np.random.default_rng(3)
    pts = rng.random((500, 4))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "row_id long, a double, b double, c double, d double")
    inert = []
    for it in range(1, 5):
        res = kmeans.lloyd(df, ["a", "b", "c", "d"], C.LloydParams(k=3, iterations=it, distance_digits=None))
        st = metrics.cluster_stats(res.labelled.withColumn(
            "cluster", kmeans.nearest_expr(["a", "b", "c", "d"], res.centres, None)), metrics.as_vector(["a", "b", "c", "d"]))
        inert.append(metrics.inertia(st))
    assert all(x >= y - 1e-9 for x, y in zip(inert, inert[1:]))


def test_k11_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    m = pca.fit_pca(df, ["a", "b", "c"])
    vals, vecs = np.linalg.eigh(np.cov(x, rowvar=False))
    assert np.allclose(m.explained_variance_ratio, vals[::-1][:2] / vals.sum())
    assert np.allclose(np.abs(m.components), np.abs(vecs[:, ::-1][:, :2].T), atol=1e-8)


def test_a10_crosstab_totals(spark):
    df = spark.createDataFrame([("A", 0), ("A", 1), ("B", 1), (None, 0)], "desa string, cluster int")
    rows = {r.desa: (r.cluster_0, r.cluster_1, r.total) for r in stats.crosstab_with_totals(df, "desa", "cluster", [0, 1]).collect()}
    assert rows == {"A": (1, 1, 2), "B": (0, 1, 1), "Total": (1, 2, 3)}


def test_global_rank_is_contiguous_and_ordered(spark):
    rng = np.random.default_rng(5)
    vals = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 2000), rng.random(2000))]
    vals += [(0, 0.5)] * 700          # a hot key with ties
    df = spark.createDataFrame(vals, "k long, v double").repartition(7)
    rows = stats.global_rank(df, ["k", "v"]).collect()
    pos = sorted(r._pos for r in rows)
    assert pos == list(range(len(vals)))
    by_pos = [(r.k, r.v) for r in sorted(rows, key=lambda r: r._pos)]
    assert by_pos == sorted(vals)


@pytest.mark.parametrize("accuracy", [10, 1000, 1_000_000])
def test_group_medians_match_numpy(spark, accuracy):
    from kohort.operators.quantiles import group_medians
    rng = np.random.default_rng(accuracy)
    rows = [("hot", float(v), float(w)) for v, w in zip(np.round(rng.normal(50, 10, 6000), 3), rng.integers(0, 5, 6000))]
    rows += [(f"g{g}", float(v), None) for g in range(5) for v in np.round(rng.random(g * 7 + 1), 2)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(6)
    got = {(r.g, r.i): r.median for r in group_medians(df, "g", ["a", "b"], accuracy).collect()}
    for g in {r[0] for r in rows}:
        for i, col in enumerate(["a", "b"]):
            vals = [r[1 + i] for r in rows if r[0] == g and r[1 + i] is not None]
            if vals:
                assert got[(g, i)] == pytest.approx(float(np.median(vals)), abs=1e-12), (g, col)
            else:
                assert (g, i) not in got


def test_quantiles_fetch_a_bounded_number_of_rows(spark, monkeypatch):
    from kohort.operators import quantiles as Q
    df = spark.range(300_000).select(F.rand(7).alias("x"), (F.col("id") % 7).cast("double").alias("ties"), F.lit(None).cast("double").alias("none"))
    df = df.cache()
    seen = []
    fetch = Q._fetch
    monkeypatch.setattr(Q, "_fetch", lambda d, w: (seen.extend(x.size for x in w), fetch(d, w))[1])
    qs = [0.0, 0.25, 0.5, 0.999, 1.0]
    pdf = df.toPandas()
    for accuracy in (10, 10000):       # with a rough sketch the first bracket holds most of the values
        got = Q.exact_quantiles(df, ["x", "ties", "none"], qs, accuracy)
        assert np.allclose(got["x"], pdf["x"].quantile(qs), atol=0) and np.allclose(got["ties"], pdf["ties"].quantile(qs))
        assert got["none"] == [None] * 5
    assert max(seen, default=0) <= Q.FETCH
    df.unpersist()


def test_histogram_has_all_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 3.0), ("b", None), ("c", None)], "g string, x double")
    rows = stats.histogram(df, "x", 4, by="g").collect()
    assert sorted((r.g, r.bin, r["count"]) for r in rows) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 0, 0), ("b", 1, 0), ("b", 2, 1), ("b", 3, 0)]


def test_vectors_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "cluster int, v array<double>")
    with pytest.raises(ValueError):
        metrics.cluster_stats(df, metrics.as_vector(array_col="v"))


def test_pair_ratios_and_several_labellings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    labels = {"p": rng.integers(0, 2, 300), "q": rng.integers(0, 5, 300), "single": np.r_[9, np.zeros(299, int)]}
    df = spark.createDataFrame([(i, x[i].tolist(), *[int(v[i]) for v in labels.values()]) for i in range(300)], "id long, v array<double>, p int, q int, single int")
    vec = metrics.as_vector(array_col="v")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r.labelling, r.id): r.silhouette for r in metrics.silhouettes(df, vec, "id", list(labels), block_rows=70).collect()}
    for name, lab in labels.items():
        for i in range(0, 300, 37):
            own = lab == lab[i]
            a = d[i, own].sum() / max(1, own.sum() - 1)
            b = min(d[i, lab == k].mean() for k in set(lab) if k != lab[i])
            assert got[name, i] == pytest.approx(0.0 if own.sum() == 1 else (b - a) / max(a, b), abs=1e-9)
    st = metrics.cluster_stats(df, vec, "q")
    pairs = {(r.cluster_i, r.cluster_j): r.ratio for r in metrics.pair_ratios(st.frame(spark)).collect()}
    assert len(pairs) == 20 and pairs[0, 1] == pairs[1, 0]
    assert metrics.davies_bouldin(st) == pytest.approx(np.mean([max(v for (i, _), v in pairs.items() if i == k) for k in range(5)]))
