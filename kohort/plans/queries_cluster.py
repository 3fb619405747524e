"""Registered clustering queries: scaling, Lloyd labels, metrics, profiles, risk rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort import config as C
from kohort.checks import sqlfrag as Q
from kohort.functions import risk
from kohort.operators import kmeans, metrics, pca, ranking
from kohort.plans.queries_clean import clean
from kohort.registry import register
from kohort.sources.tables import table

S_COLS = [kmeans.SCALED_PREFIX + f for f in C.FEATURES]
LLOYD = C.LloydParams()


def scaled(spark, sf):
    res = clean(spark, sf, sort=False)
    df, model = kmeans.scale(res.table, C.FEATURES)
    return df, model


def clustered(spark, sf):
    """Clean table + scaled features + K03 labels (k=3, 5 iterations, first 3 rows)."""
    df, _ = scaled(spark, sf)
    return kmeans.lloyd(df, S_COLS, LLOYD)


def _r(c, d):
    return F.round(F.col(c), d).alias(c)


@register("k01_scaled_features", Q.with_clean(
    "SELECT row_id, " + ", ".join(f"{Q.rnd('s_' + f, 9)} AS s_{f}" for f in C.FEATURES) + " FROM scaled",
    Q.scaled_cte()))
def k01(spark, sf):
    df, _ = scaled(spark, sf)
    return df.select("row_id", *[_r(c, 9) for c in S_COLS])


@register("k03_lloyd_labels", Q.with_lloyd("SELECT row_id, cluster FROM labels"))
def k03_labels(spark, sf):
    return clustered(spark, sf).labelled.select("row_id", "cluster")


@register("k03_lloyd_centres", Q.with_lloyd(
    "SELECT cluster, " + ", ".join(f"{Q.rnd(c, 6)} AS {c}" for c in S_COLS) + " FROM centres"))
def k03_centres(spark, sf):
    res = clustered(spark, sf)
    rows = [(j, *[kmeans.round_half_up(v, 6) for v in c]) for j, c in enumerate(res.centres)]
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{c} double" for c in S_COLS))


# --- profiles on the Lloyd clusters ----------------------------------------------
PROFILE = [f for f in Q.CLEAN_FEATURES]      # what the oracle expects; the queries take theirs from the cleaning result


def profiled(spark, sf):
    """(K03 labels, the features that cleaning kept)."""
    res = clean(spark, sf, sort=False)
    df, _ = kmeans.scale(res.table, C.FEATURES)
    return kmeans.lloyd(df, S_COLS, LLOYD).labelled, res.features


@register("a07_cluster_sizes", Q.with_lloyd("SELECT cluster, count(*) AS n FROM labels GROUP BY cluster"))
def a07(spark, sf):
    return clustered(spark, sf).labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("a08_cluster_profile", Q.with_lloyd(
    "SELECT cluster, count(*) AS n, " + ", ".join(f"{Q.rnd(f'avg({f})', 2)} AS {f}" for f in PROFILE)
    + " FROM result GROUP BY cluster"))
def a08(spark, sf):
    lab, feats = profiled(spark, sf)
    return ranking.cluster_means(lab, feats, digits=2)


@register("a09_scaled_cluster_means", Q.with_lloyd(
    "SELECT cluster, " + ", ".join(f"{Q.rnd(f'avg(s_{f})', 4)} AS s_{f}" for f in PROFILE)
    + " FROM labels JOIN scaled USING (row_id) GROUP BY cluster"))
def a09(spark, sf):
    lab, feats = profiled(spark, sf)
    return lab.groupBy("cluster").agg(*[F.round(F.avg("s_" + f), 4).alias("s_" + f) for f in feats])


_KEY = [f for f in C.RISK_KEY_FEATURES if f in Q.CLEAN_COLUMNS]


def _rank_sql(round_means: int | None = None):
    mean = (lambda f: Q.rnd(f"avg({f})", round_means)) if round_means else (lambda f: f"avg({f})")
    means = ", ".join(f"{mean(f)} AS {f}" for f in _KEY)
    return (f"cm AS (SELECT cluster, {means} FROM result GROUP BY cluster),\n"
            f"sc AS (SELECT cluster, {Q.risk_score_sql()} AS risk_score FROM cm),\n"
            "rk AS (SELECT cluster, risk_score, row_number() OVER (ORDER BY risk_score, cluster) AS r, "
            "count(*) OVER () AS n FROM sc),\n"
            "ranked AS (SELECT cluster, risk_score, CASE WHEN r = n THEN 'RISIKO TINGGI' WHEN r = 1 THEN "
            "'RELATIF SEHAT' ELSE 'RISIKO SEDANG' END AS risk_label, CASE WHEN r = n THEN 'Tinggi' WHEN r = 1 "
            "THEN 'Sehat' ELSE 'Sedang' END AS risk_level FROM rk)")


def ranked_clusters(spark, sf, round_means: int | None = None):
    lab = clustered(spark, sf).labelled
    means = ranking.cluster_means(lab, _KEY, digits=round_means)
    return lab, ranking.rank_clusters(means)


@register("k16_cluster_risk_levels", Q.with_lloyd(
    "SELECT cluster, risk_score, risk_label, risk_level FROM ranked", _rank_sql()))
def k16(spark, sf):
    _, ranked = ranked_clusters(spark, sf)
    return ranked.select("cluster", "risk_score", "risk_label", "risk_level")


@register("k15_risk_score_rounded_means", Q.with_lloyd(
    "SELECT cluster, risk_score, risk_label FROM ranked", _rank_sql(round_means=2)))
def k15(spark, sf):
    _, ranked = ranked_clusters(spark, sf, round_means=2)
    return ranked.select("cluster", "risk_score", "risk_label")


def _filled_sql():
    def score(kept):
        means = ", ".join(f"{f'avg({f})' if f != 'imt' else '0.0::DOUBLE'} AS {f}" for f in _KEY if kept or f != "imt")
        return f"SELECT cluster, {Q.risk_score_sql(() if kept else ('imt',))} AS risk_score FROM (SELECT cluster, {means} FROM result GROUP BY cluster)"
    return f"SELECT cluster, a.risk_score AS score_filled, b.risk_score AS score_surviving FROM ({score(True)}) a JOIN ({score(False)}) b USING (cluster)"


@register("k15_ignore_filled", Q.with_lloyd(_filled_sql()))
def k15_filled(spark, sf):
    """K15 where the body mass index was dropped and refilled with 0, by default and with the refilled
    feature ignored."""
    lab = clustered(spark, sf).labelled.withColumn("imt", F.lit(0.0))
    means = ranking.cluster_means(lab, _KEY)
    ignored = ranking.rank_clusters(means, filled=("imt",)).select("cluster", F.col("risk_score").alias("score_surviving"))
    return ranking.rank_clusters(means).select("cluster", F.col("risk_score").alias("score_filled")).join(ignored, "cluster")


def _tag_sql(f):
    cuts, fb = C.INTERPRET_TAGS[f]
    whens = " ".join(f"WHEN {f} >= {t} THEN '{tag}'" for t, tag in cuts)
    return f"CASE {whens} ELSE '{fb}' END AS {f}_tag"


def _lines_sql():
    def mean(f, d):     # the rounded mean as text with d decimals
        return f"CAST(CAST({Q.rnd(f, d)} AS DECIMAL(18,{d})) AS VARCHAR)"
    tag = {f: _tag_sql(f).removesuffix(f" AS {f}_tag") for f in C.INTERPRET_LINES}
    lines = [f"'{h}' || {mean(f, d)} || '{u} (' || {tag[f]} || ')'" for f, (h, d, u) in C.INTERPRET_LINES.items()]
    note = "CASE risk_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.RISK_NOTES.items()) + " END"
    return " || chr(10) || ".join([*lines, f"'{C.INTERPRET_CONCLUSION}' || risk_label || ' ' || {note}"])


@register("k17_cluster_interpretation", Q.with_lloyd(
    "SELECT cm.cluster, n, " + ", ".join(_tag_sql(f) for f in C.INTERPRET_TAGS) +
    ", risk_label, CASE risk_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.RISK_NOTES.items()) +
    " END AS risk_note, " + ", ".join(f"{Q.rnd(f, 2)} AS {f}" for f in C.INTERPRET_TAGS) + ", " + _lines_sql() + " AS lines FROM cm JOIN ranked USING (cluster)",
    _rank_sql().replace("cm AS (SELECT cluster,", "cm AS (SELECT cluster, count(*) AS n,")))
def k17(spark, sf):
    lab, ranked = ranked_clusters(spark, sf)
    means = ranking.cluster_means(lab, _KEY)
    notes = F.create_map(*[x for k, v in C.RISK_NOTES.items() for x in (F.lit(k), F.lit(v))])
    return (means.join(F.broadcast(ranked.select("cluster", "risk_label")), "cluster")
            .select("cluster", "n", *[risk.interpret_tag(f).alias(f"{f}_tag") for f in C.INTERPRET_TAGS],
                    "risk_label", notes[F.col("risk_label")].alias("risk_note"), *[_r(f, 2) for f in C.INTERPRET_TAGS],
                    risk.interpretation_lines(list(C.INTERPRET_TAGS)).alias("lines")))


@register("k19_report_conclusion", Q.with_lloyd(
    "SELECT cluster, CASE WHEN s >= 3 THEN 'Tinggi' WHEN s >= 1 THEN 'Sedang' ELSE 'Rendah (Sehat)' END AS conclusion "
    "FROM (SELECT cluster, (coalesce(umur >= 70, false)::INT + coalesce(imt >= 30 OR imt < 18.5, false)::INT + "
    "coalesce(sistolik >= 140, false)::INT + coalesce(kolesterol >= 200, false)::INT + "
    "coalesce(gds_1 >= 140, false)::INT) AS s FROM (SELECT cluster, " +
    ", ".join(f"{Q.rnd(f'avg({f})', 2)} AS {f}" for f in _KEY) + " FROM result GROUP BY cluster))"))
def k19(spark, sf):
    m = ranking.cluster_means(clustered(spark, sf).labelled, _KEY, digits=2)
    return m.select("cluster", risk.report_conclusion().alias("conclusion"))


# --- metrics on the embeddings table (given labels) -------------------------------
EMB = "CAST(embedding AS DOUBLE[])"


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def _eval_sql(label: str = "label"):
    return f"""WITH e AS (SELECT vec_id, {label} AS label, {EMB} AS v FROM embeddings),
ex AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
cent AS (SELECT label, i, avg(x) AS m FROM ex GROUP BY label, i),
dist AS (SELECT ex.vec_id, ex.label, sqrt(sum((x - m) * (x - m))) AS d, sum((x - m) * (x - m)) AS d2
         FROM ex JOIN cent USING (label, i) GROUP BY ex.vec_id, ex.label),
disp AS (SELECT label, avg(d) AS s, sum(d2) AS w, count(*) AS n FROM dist GROUP BY label),
gm AS (SELECT i, avg(x) AS g FROM ex GROUP BY i),
ssb AS (SELECT sum(n * dd) AS b FROM (SELECT label, sum((m - g) * (m - g)) AS dd FROM cent JOIN gm USING (i)
        GROUP BY label) JOIN disp USING (label)),
cd AS (SELECT a.label AS li, b.label AS lj, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dij FROM cent a JOIN cent b
       ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label),
r AS (SELECT li, max(CASE WHEN dij > 0 THEN (si.s + sj.s) / dij ELSE 0 END) AS r FROM cd
      JOIN disp si ON si.label = li JOIN disp sj ON sj.label = lj GROUP BY li),
pairs AS (SELECT a.vec_id, a.label AS own, b.label AS ref, list_distance(a.v, b.v) AS d FROM e a JOIN e b
          ON a.vec_id <> b.vec_id),
per AS (SELECT vec_id, own, ref, avg(d) AS md FROM pairs GROUP BY vec_id, own, ref),
sil AS (SELECT vec_id, own, max(md) FILTER (WHERE ref = own) AS a, min(md) FILTER (WHERE ref <> own) AS b
        FROM per GROUP BY vec_id, own),
pt AS (SELECT vec_id, own, a, b, CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM sil),
k AS (SELECT count(*) AS nk, (SELECT count(*) FROM e) AS n FROM disp),
ev AS (SELECT {Q.rnd('(SELECT avg(s) FROM pt)', 4)} AS silhouette_score,
  {Q.rnd('(SELECT avg(r) FROM r)', 4)} AS davies_bouldin_index,
  {Q.rnd('(SELECT b FROM ssb) * (n - nk) / ((SELECT sum(w) FROM disp) * (nk - 1))', 4)} AS calinski_harabasz_score,
  {Q.rnd('(SELECT sum(w) FROM disp)', 2)} AS inertia FROM k)"""


def embedding_evaluation(spark, sf):
    df = _emb(spark, sf)
    vec = metrics.as_vector(array_col="embedding")
    known = metrics.label_sizes(df, vec, ["label"])
    st = metrics.cluster_stats_of(df, vec, ["label"], known[0])["label"]
    sil = metrics.silhouette_mean(metrics.silhouettes(df, vec, "vec_id", ["label"], known=known))
    return {"silhouette_score": kmeans.round_half_up(sil, 4),
            "davies_bouldin_index": kmeans.round_half_up(metrics.davies_bouldin(st), 4),
            "calinski_harabasz_score": kmeans.round_half_up(metrics.calinski_harabasz(st), 4),
            "inertia": kmeans.round_half_up(metrics.inertia(st), 2)}


@register("k06_cluster_evaluation", _eval_sql() + "\nSELECT * FROM ev")
def k06(spark, sf):
    ev = embedding_evaluation(spark, sf)
    return spark.createDataFrame([tuple(ev.values())], ", ".join(f"{k} double" for k in ev))


@register("k07_silhouette_points", _eval_sql() +
          f"\nSELECT vec_id, own AS label, {Q.rnd('a', 6)} AS a, {Q.rnd('b', 6)} AS b, {Q.rnd('s', 6)} AS silhouette FROM pt")
def k07(spark, sf):
    df = _emb(spark, sf)
    pts = metrics.silhouette_points(df, metrics.as_vector(array_col="embedding"), "vec_id", "label")
    return pts.select("vec_id", F.col("label").cast("int").alias("label"), _r("a", 6), _r("b", 6), _r("silhouette", 6))


@register("k08_cluster_dispersion", _eval_sql() +
          f"\nSELECT label, n, {Q.rnd('s', 6)} AS dispersion, {Q.rnd('w', 6)} AS within_ss FROM disp")
def k08(spark, sf):
    df = _emb(spark, sf)
    st = metrics.cluster_stats(df, metrics.as_vector(array_col="embedding"), "label")
    rows = [(int(k), int(n), kmeans.round_half_up(s, 6), kmeans.round_half_up(w, 6))
            for k, n, s, w in zip(st.ids, st.counts, st.spread, st.ssw)]
    return spark.createDataFrame(rows, "label int, n long, dispersion double, within_ss double")


_METRIC = {"silhouette": ("silhouette_score", ">=", C.SILHOUETTE_CUTS), "dbi": ("davies_bouldin_index", "<=", C.DBI_CUTS),
           "ch": ("calinski_harabasz_score", ">=", C.CH_CUTS)}
_BAND_TEXTS = [(f"{m}_{kind}", *_METRIC[m], texts[m] if isinstance(texts, dict) else texts) for kind, texts in
               (("colour", C.BAND_COLOURS), ("description", C.BAND_DESCRIPTIONS), ("report", C.REPORT_BANDS)) for m in _METRIC
               if not isinstance(texts, dict) or m in texts]


@register("k20_quality_bands", _eval_sql() +
          "\nSELECT silhouette_score, davies_bouldin_index, calinski_harabasz_score, "
          "CASE WHEN silhouette_score >= 0.7 THEN 'Sangat Baik' WHEN silhouette_score >= 0.5 THEN 'Baik' "
          "WHEN silhouette_score >= 0.25 THEN 'Cukup' ELSE 'Kurang' END AS silhouette_band, "
          "CASE WHEN davies_bouldin_index <= 0.5 THEN 'Sangat Baik' WHEN davies_bouldin_index <= 1.0 THEN 'Baik' "
          "WHEN davies_bouldin_index <= 2.0 THEN 'Cukup' ELSE 'Kurang' END AS dbi_band, "
          "CASE WHEN calinski_harabasz_score >= 500 THEN 'Sangat Baik' WHEN calinski_harabasz_score >= 200 THEN 'Baik' "
          "WHEN calinski_harabasz_score >= 100 THEN 'Cukup' ELSE 'Kurang' END AS ch_band, " + ", ".join(
              f"CASE WHEN {x} {op} {cuts[0]} THEN '{v[0]}' WHEN {x} {op} {cuts[1]} THEN '{v[1]}' WHEN {x} {op} {cuts[2]} THEN '{v[2]}' ELSE '{v[3]}' END AS {n}"
              for n, x, op, cuts, v in _BAND_TEXTS) + " FROM ev")
def k20(spark, sf):
    df = k06(spark, sf)
    return df.select("silhouette_score", "davies_bouldin_index", "calinski_harabasz_score",
                     risk.quality_band("silhouette_score", "silhouette").alias("silhouette_band"),
                     risk.quality_band("davies_bouldin_index", "dbi").alias("dbi_band"),
                     risk.quality_band("calinski_harabasz_score", "ch").alias("ch_band"),
                     *[risk.quality_band(x, n.split("_")[0], labels=v).alias(n) for n, x, _, _, v in _BAND_TEXTS])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@register("k20_metric_texts", _eval_sql() + "\n" + " UNION ALL ".join(
    f"SELECT {_quoted(m)} AS metric, {_METRIC[m][0]} AS score, {_quoted(explanation)} AS explanation, {_quoted(formula)} AS formula, "
    f"{_quoted('; '.join(good))} AS strengths, {_quoted('; '.join(bad))} AS weaknesses FROM ev"
    for m, (explanation, formula, good, bad) in C.METRIC_TEXTS.items()))
def k20_texts(spark, sf):
    """A row a metric: its value, and what the evaluation page says of the metric."""
    scores = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("score")) for m, (c, _, _) in _METRIC.items()])
    rows = k06(spark, sf).select(F.explode(scores).alias("m")).select("m.*", risk.metric_texts("m.metric").alias("t"))
    return rows.select("metric", "score", "t.explanation", "t.formula", F.array_join("t.strengths", "; ").alias("strengths"),
                       F.array_join("t.weaknesses", "; ").alias("weaknesses"))


# --- metrics on the screening clusters -------------------------------------------------
def _lloyd_eval_sql():
    s = [f"s_{f}" for f in C.FEATURES]
    vec = "[" + ", ".join(s) + "]::DOUBLE[]"
    return Q.with_lloyd(
        "SELECT " + Q.rnd("avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END)", 4) +
        " AS silhouette_score FROM (SELECT p, own, max(md) FILTER (WHERE ref = own) AS a, "
        "min(md) FILTER (WHERE ref <> own) AS b FROM (SELECT x.row_id AS p, x.cluster AS own, y.cluster AS ref, "
        "avg(list_distance(x.v, y.v)) AS md FROM pts x JOIN pts y ON x.row_id <> y.row_id GROUP BY ALL) GROUP BY ALL)",
        f"pts AS (SELECT row_id, cluster, {vec} AS v FROM labels JOIN scaled USING (row_id))")


@register("k07_silhouette_screening", _lloyd_eval_sql())
def k07_screening(spark, sf):
    lab = clustered(spark, sf).labelled
    sil = metrics.silhouette_mean(metrics.silhouette_points(lab, metrics.as_vector(S_COLS), "row_id"))
    return spark.createDataFrame([(kmeans.round_half_up(sil, 4),)], "silhouette_score double")


@register("k10_inertia_screening", Q.with_lloyd(
    f"SELECT {Q.rnd('sum(d2)', 4)} AS inertia FROM (SELECT " +
    " + ".join(f"(s_{f} - m_{f}) * (s_{f} - m_{f})" for f in C.FEATURES) +
    " AS d2 FROM labels JOIN scaled USING (row_id) JOIN (SELECT cluster, " +
    ", ".join(f"avg(s_{f}) AS m_{f}" for f in C.FEATURES) +
    " FROM labels JOIN scaled USING (row_id) GROUP BY cluster) USING (cluster))"))
def k10(spark, sf):
    lab = clustered(spark, sf).labelled
    st = metrics.cluster_stats(lab, metrics.as_vector(S_COLS))
    return spark.createDataFrame([(kmeans.round_half_up(metrics.inertia(st), 4),)], "inertia double")


# --- K12 covariance / K11 PCA ------------------------------------------------------
@register("k12_covariance", Q.with_clean(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, {Q.rnd(f'covar_samp({a}, {b})', 6)} AS covariance FROM clean"
        for i, a in enumerate(Q.CLEAN_FEATURES) for b in Q.CLEAN_FEATURES[i:]) + ")"))
def k12(spark, sf):
    res = clean(spark, sf, sort=False)
    return pca.covariance_long(res.table, res.features).withColumn("covariance", F.round("covariance", 6))


_PCA_VARS = ", ".join(f"{Q.rnd(f'(SELECT l FROM lam{n}) / (SELECT t FROM trace)', 6)} AS var_pc{n}" for n in (1, 2))


@register("k11_pca_2d", Q.with_pca(
    f"SELECT row_id, labels.cluster, {Q.rnd('pc1', 4)} AS x, {Q.rnd('pc2', 4)} AS y, nama, desa, {_PCA_VARS} FROM proj JOIN labels USING (row_id) JOIN clean USING (row_id)"))
def k11(spark, sf):
    res = clustered(spark, sf)
    model = pca.fit_pca(res.labelled, S_COLS, 2)
    out = pca.project(res.labelled, model)
    return out.select("row_id", "cluster", F.round("pc1", 4).alias("x"), F.round("pc2", 4).alias("y"),
                      "nama", "desa",
                      *[F.lit(round(float(v), 6)).alias(f"var_pc{i}") for i, v in enumerate(model.explained_variance_ratio[:2], 1)])


# --- K02 / K04 / K05 K-Means with restarts -------------------------------------------
_SWEEP_KS = list(range(2, C.KMeansParams().max_k + 1))
_S = [f"s_{f}" for f in C.FEATURES]
_D2 = " + ".join(f"(p.{x} - c.{x}) * (p.{x} - c.{x})" for x in _S)


def _kevals_ctes(ks) -> str:
    """``kevals`` (k, inertia, silhouette_score, davies_bouldin_index, calinski_harabasz_score) of the labels
    of the best fits, and ``kmeans_inertia`` (k, inertia) about the clusters' means."""
    d = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in _S)
    return f"""ksz AS (SELECT k, cluster, count(*) AS n FROM klabels GROUP BY k, cluster),
kprs AS (SELECT a.row_id AS i, b.row_id AS j, sqrt({d}) AS d FROM pts a JOIN pts b ON a.row_id <> b.row_id),
ksm AS (SELECT l.k, p.i, l.cluster AS cj, sum(p.d) AS t FROM kprs p JOIN klabels l ON l.row_id = p.j GROUP BY l.k, p.i, l.cluster),
kpt AS (SELECT l.k, l.row_id, max(own.n) AS n, max(CASE WHEN m.cj = l.cluster THEN m.t END) / nullif(max(own.n) - 1, 0) AS a, min(CASE WHEN m.cj <> l.cluster THEN m.t / z.n END) AS b
  FROM klabels l JOIN ksm m ON m.k = l.k AND m.i = l.row_id JOIN ksz z ON z.k = m.k AND z.cluster = m.cj JOIN ksz own ON own.k = l.k AND own.cluster = l.cluster GROUP BY l.k, l.row_id),
ksil AS (SELECT k, avg(CASE WHEN n < 2 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END) AS s FROM kpt GROUP BY k),
kmean AS (SELECT l.k, l.cluster, count(*) AS n, {', '.join(f'avg(p.{x}) AS {x}' for x in _S)} FROM pts p JOIN klabels l USING (row_id) GROUP BY l.k, l.cluster),
kdisp AS (SELECT l.k, l.cluster, avg(sqrt({_D2})) AS s, sum({_D2}) AS w FROM pts p JOIN klabels l USING (row_id) JOIN kmean c ON c.k = l.k AND c.cluster = l.cluster GROUP BY l.k, l.cluster),
kdbi AS (SELECT k, avg(r) AS dbi FROM (SELECT a.k, a.cluster, max(coalesce((x.s + y.s) / nullif(sqrt({d}), 0), 0)) AS r FROM kmean a JOIN kmean b ON a.k = b.k AND a.cluster <> b.cluster
  JOIN kdisp x ON x.k = a.k AND x.cluster = a.cluster JOIN kdisp y ON y.k = b.k AND y.cluster = b.cluster GROUP BY a.k, a.cluster) GROUP BY k),
kall AS (SELECT count(*) AS n, {', '.join(f'avg({x}) AS {x}' for x in _S)} FROM pts),
kch AS (SELECT p.k, sum(p.n * ({_D2})) AS ssb, max(c.n) AS n, count(*) AS nk, (SELECT sum(w) FROM kdisp g WHERE g.k = p.k) AS ssw FROM kmean p, kall c GROUP BY p.k),
kmeans_inertia AS (SELECT k, {Q.rnd('sum(w)', 2)} AS inertia FROM kdisp GROUP BY k),
kevals AS (SELECT best.k, best.cost AS inertia, {Q.rnd('ksil.s', 4)} AS silhouette_score, {Q.rnd('kdbi.dbi', 4)} AS davies_bouldin_index,
  {Q.rnd('kch.ssb * (kch.n - kch.nk) / (kch.ssw * (kch.nk - 1))', 4)} AS calinski_harabasz_score FROM best JOIN ksil USING (k) JOIN kdbi USING (k) JOIN kch USING (k))"""


_SWEEP_SQL = Q.with_kmeans("SELECT * FROM kevals", _SWEEP_KS, _kevals_ctes(_SWEEP_KS))


@register("k02_kmeans_labels", Q.with_kmeans("SELECT row_id, cluster, 'Cluster ' || cluster AS cluster_label FROM klabels", [3]))
def k02(spark, sf):
    df, _ = scaled(spark, sf)
    labelled, _, _ = kmeans.kmeans_labels(df, S_COLS, 3, C.KMeansParams())
    return labelled.select("row_id", "cluster", F.concat(F.lit("Cluster "), F.col("cluster")).alias("cluster_label"))


@register("k04_elbow_k1", Q.with_clean(
    f"SELECT 1 AS k, {Q.rnd(' + '.join(f'coalesce(var_pop(s_{f}) * count(s_{f}), 0)' for f in C.FEATURES), 6)} AS inertia FROM scaled",
    Q.scaled_cte()))
def k04_k1(spark, sf):
    df, _ = scaled(spark, sf)
    return spark.createDataFrame([(1, kmeans.round_half_up(kmeans.total_sum_squares(df, S_COLS), 6))],
                                 "k int, inertia double")


@register("k05_k_sweep", _SWEEP_SQL)
def k05(spark, sf):
    from kohort.plans.clustering import evaluate_k_range
    df, _ = scaled(spark, sf)
    return evaluate_k_range(df, S_COLS, "row_id")


# --- K18 recommendations (on 2-place means, as the interpretation page) -----------
def _rec_sql():
    def w(cond, text):
        return f"CASE WHEN {cond} THEN '{text}' END"
    items = [
        f"CASE WHEN umur >= 70 THEN '{C.REC_AGE_70}' WHEN umur >= 60 THEN '{C.REC_AGE_60}' END",
        f"CASE WHEN imt >= 30 THEN '{C.REC_BMI_30}' WHEN imt >= 25 THEN '{C.REC_BMI_25}' "
        f"WHEN imt < 18.5 THEN '{C.REC_BMI_UNDER}' END",
        f"CASE WHEN sistolik >= 140 THEN '{C.REC_SYS_140}' WHEN sistolik >= 120 THEN '{C.REC_SYS_120}' END",
        f"CASE WHEN gds_1 >= 200 THEN '{C.REC_GLU_200}' WHEN gds_1 >= 140 THEN '{C.REC_GLU_140}' "
        f"WHEN gds_1 >= 100 THEN '{C.REC_GLU_100}' END",
        w("kolesterol >= 200", C.REC_CHOL_200),
        "CASE risk_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.REC_GENERAL.items()) + " END",
    ]
    lv = "CASE risk_label " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in C.LEVEL_META.items()) + " END"
    co = "CASE risk_label " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in C.LEVEL_META.items()) + " END"
    de = "CASE risk_label " + " ".join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in C.LEVEL_META.items()) + " END"
    return Q.with_lloyd(
        f"SELECT cluster, {lv} AS level, {co} AS color, {de} AS description, {Q.rnd('risk_score', 2)} AS risk_score, "
        "array_to_string(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), ' | ') AS recommendations "
        "FROM cm JOIN sc USING (cluster) JOIN ranked USING (cluster, risk_score)",
        _rank_sql(round_means=2).replace(
            "cm AS (SELECT cluster,", "cm AS (SELECT cluster,", 1))


@register("k18_recommendations", _rec_sql())
def k18(spark, sf):
    lab = clustered(spark, sf).labelled
    means = ranking.cluster_means(lab, _KEY, digits=2)
    ranked = ranking.rank_clusters(means)
    meta = risk.level_meta()
    return ranked.select("cluster", meta["level"].alias("level"), meta["color"].alias("color"), meta["description"].alias("description"),
                         F.round("risk_score", 2).alias("risk_score"),
                         F.array_join(risk.recommendations(present=_KEY), " | ").alias("recommendations"))


# --- K04 / K21-K23 compositions and their exports ------------------------------------
_TOTAL_SS = " + ".join(f"coalesce(var_pop({x}) * count({x}), 0)" for x in _S)


@register("k04_elbow", Q.with_kmeans(f"SELECT 1 AS k, {Q.rnd(_TOTAL_SS, 6)} AS inertia FROM pts UNION ALL SELECT k, cost FROM best", _SWEEP_KS))
def k04(spark, sf):
    df, _ = scaled(spark, sf)
    pts = [(k, kmeans.round_half_up(v, 6)) for k, v in kmeans.elbow(df, S_COLS)]
    return spark.createDataFrame(pts, "k int, inertia double")


def _run(spark, sf):
    from kohort.plans.clustering import run_clustering
    return run_clustering(clean(spark, sf, sort=False).table)


@register("k23_clustering_result", Q.with_kmeans(
    "SELECT row_id, desa, nama, cluster, 'Cluster ' || cluster AS cluster_label, " + ", ".join(f"{Q.rnd(x, 9)} AS {x}" for x in _S) +
    " FROM scaled JOIN klabels USING (row_id)", [3]))
def k23(spark, sf):
    run = _run(spark, sf)
    return run.result.select("row_id", "desa", "nama", "cluster", "cluster_label", *[_r(c, 9) for c in S_COLS])


def _band_sql(column, metric):
    _, op, cuts = _METRIC[metric]
    return "CASE " + " ".join(f"WHEN {column} {op} {t} THEN '{b}'" for t, b in zip(cuts, C.BAND_LABELS)) + f" ELSE '{C.BAND_LABELS[len(cuts)]}' END"


@register("k21_evaluation_summary", Q.with_kmeans(
    "SELECT (SELECT k FROM kevals ORDER BY silhouette_score DESC, k LIMIT 1) AS best_k_silhouette, "
    "(SELECT k FROM kevals ORDER BY davies_bouldin_index, k LIMIT 1) AS best_k_dbi, "
    "(SELECT k FROM kevals ORDER BY calinski_harabasz_score DESC, k LIMIT 1) AS best_k_ch, "
    f"{_band_sql('silhouette_score', 'silhouette')} AS silhouette_band, {_band_sql('davies_bouldin_index', 'dbi')} AS dbi_band, "
    f"{_band_sql('calinski_harabasz_score', 'ch')} AS ch_band, silhouette_score, davies_bouldin_index, calinski_harabasz_score, "
    "i.inertia FROM kevals JOIN kmeans_inertia i USING (k) WHERE k = 3", _SWEEP_KS, _kevals_ctes(_SWEEP_KS)))
def k21(spark, sf):
    from kohort.plans.clustering import evaluation_summary
    s = evaluation_summary(_run(spark, sf))
    b, q, m = s["best_k"], s["quality"], s["metrics"]
    return spark.createDataFrame([(b["best_k_silhouette"], b["best_k_davies_bouldin"], b["best_k_calinski_harabasz"],
                                   q["silhouette"], q["davies_bouldin"], q["calinski_harabasz"],
                                   m["silhouette_score"], m["davies_bouldin_index"], m["calinski_harabasz_score"],
                                   m["inertia"])],
                                 "best_k_silhouette int, best_k_dbi int, best_k_ch int, silhouette_band string, "
                                 "dbi_band string, ch_band string, silhouette_score double, davies_bouldin_index double, "
                                 "calinski_harabasz_score double, inertia double")


@register("k22_clustering_summary", Q.with_kmeans(
    "SELECT l.cluster, count(*) AS n, " + ", ".join(f"{Q.rnd(f'avg(clean.{f})', 2)} AS {f}" for f in PROFILE) + ", " +
    ", ".join(f"{Q.rnd(f'max(c.s_{f})', 4)} AS c_{f}" for f in C.FEATURES) +
    " FROM clean JOIN klabels l USING (row_id) JOIN kcentres c ON c.cluster = l.cluster GROUP BY l.cluster", [3]))
def k22(spark, sf):
    """A07 sizes + K14 centres + A08 profile (2 places) of the K-Means (k=3) run."""
    res = clean(spark, sf, sort=False)
    df, _ = kmeans.scale(res.table, C.FEATURES)
    labelled, centres, _ = kmeans.kmeans_labels(df, S_COLS, 3)
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    prof = ranking.cluster_means(labelled, res.features, digits=2).drop("n")
    cents = kmeans.centres_frame(spark, centres, [f"c_{f}" for f in C.FEATURES]).drop("cluster_label")
    return sizes.join(prof, "cluster").join(cents, "cluster")   # K rows each


@register("s16_k_evaluation_export", _SWEEP_SQL)
def s16(spark, sf):
    from kohort.plans.clustering import evaluate_k_range
    df, _ = scaled(spark, sf)
    return evaluate_k_range(df, S_COLS, "row_id")


@register("s15_scaled_export", Q.with_lloyd(
    "SELECT row_id, " + ", ".join(f"{Q.rnd(c, 9)} AS {c}" for c in S_COLS) + ", cluster FROM labels JOIN scaled USING (row_id)"))
def s15(spark, sf):
    from kohort.sources import exports
    lab = clustered(spark, sf).labelled
    return exports.scaled_export(lab.select("row_id", *[_r(c, 9) for c in S_COLS], "cluster"),
                                 ["row_id", *S_COLS])


@register("s19_evaluation_parameters", _eval_sql() +
          "\nSELECT parameter, value FROM (SELECT 10.0::DOUBLE AS k, * FROM ev) "
          "UNPIVOT (value FOR parameter IN (k, silhouette_score, davies_bouldin_index, calinski_harabasz_score, "
          "inertia))")
def s19(spark, sf):
    from kohort.sources import exports
    ev = k06(spark, sf).withColumn("k", F.lit(10))
    out = exports.evaluation_parameters(ev)
    names = {"Jumlah Cluster (K)": "k", "Silhouette Score": "silhouette_score",
             "Davies-Bouldin Index": "davies_bouldin_index", "Calinski-Harabasz Score": "calinski_harabasz_score",
             "Inertia (SSE)": "inertia"}
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return out.select(m[F.col("parameter")].alias("parameter"), "value")


@register("k13_scatter_dataset", Q.with_pca(
    f"SELECT {Q.rnd('pc1', 4)} AS x, {Q.rnd('pc2', 4)} AS y, labels.cluster, nama, desa, {_PCA_VARS} FROM proj JOIN labels USING (row_id) JOIN clean USING (row_id)"))
def k13(spark, sf):
    """PCA x/y (4 places), cluster, name and village ('' only when the column is absent), and
    the variance ratios of the two axes."""
    res = clustered(spark, sf)
    model = pca.fit_pca(res.labelled, S_COLS, 2)
    out = pca.project(res.labelled, model)
    name = F.col("nama") if "nama" in out.columns else F.lit("")
    desa = F.col("desa") if "desa" in out.columns else F.lit("")
    return out.select(F.round("pc1", 4).alias("x"), F.round("pc2", 4).alias("y"), "cluster",
                      name.alias("nama"), desa.alias("desa"),
                      *[F.lit(round(float(v), 6)).alias(f"var_pc{i}") for i, v in enumerate(model.explained_variance_ratio[:2], 1)])


@register("w03_nearest_initial_centre", Q.with_clean("SELECT row_id, cluster FROM a1",
                                                      Q.scaled_cte(), Q.lloyd_ctes(iterations=1)))
def w03(spark, sf):
    """Assignment to the first k rows' centres (distances rounded, ties -> lowest id)."""
    df, _ = scaled(spark, sf)
    res = kmeans.lloyd(df, S_COLS, C.LloydParams(k=LLOYD.k, iterations=1))
    return res.labelled.select("row_id", "cluster")


@register("f07_feature_medians", Q.with_clean(
    "SELECT " + ", ".join(f"{Q.rnd(f'coalesce(quantile_cont({f}, 0.5), 0)', 6)} AS {f}" for f in Q.CLEAN_FEATURES)
    + " FROM clean"))
def f07(spark, sf):
    from kohort.operators.quantiles import exact_medians
    res = clean(spark, sf, sort=False)
    med = exact_medians(res.table, res.features)
    return spark.createDataFrame([tuple(kmeans.round_half_up(med[f] or 0.0, 6) for f in res.features)],
                                 ", ".join(f"{f} double" for f in res.features))


@register("k09_calinski_harabasz", _eval_sql() +
          f"\nSELECT calinski_harabasz_score, {Q.rnd('(SELECT b FROM ssb) / (nk - 1) / ((SELECT sum(w) FROM disp) / (n - nk))', 4)} "
          "AS ch_explicit FROM ev, k")
def k09(spark, sf):
    df = _emb(spark, sf)
    st = metrics.cluster_stats(df, metrics.as_vector(array_col="embedding"), "label")
    return spark.createDataFrame(
        [(kmeans.round_half_up(metrics.calinski_harabasz(st), 4),
          kmeans.round_half_up(metrics.calinski_harabasz(st, explicit_guards=True), 4))],
        "calinski_harabasz_score double, ch_explicit double")
