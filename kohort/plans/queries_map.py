"""Registered risk-map queries: K25 and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort import config as C
from kohort.checks import sqlfrag as Q
from kohort.functions import risk, text
from kohort.operators import villages
from kohort.plans import riskmap
from kohort.plans.queries_clean import clean
from kohort.plans.queries_cluster import _rank_sql, clustered, ranked_clusters
from kohort.registry import register
from kohort.sources.tables import raw_screening, village_boundary

WS_RE = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in C.WHITESPACE) + "]+"


def norm_sql(x: str, null_as: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN '{null_as}' WHEN {x} = '' THEN '' "
            f"ELSE upper(regexp_replace({Q.strip(x)}, '{WS_RE}', ' ', 'g')) END")


def title_sql(s: str) -> str:
    return (f"CASE WHEN length({s}) = 0 THEN {s} ELSE array_to_string(list_transform(range(1, length({s}) + 1), "
            f"lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substring({s}, i - 1, 1), '\\p{{L}}') "
            f"THEN upper(substring({s}, i, 1)) ELSE substring({s}, i, 1) END), '') END")


def display_sql(alt: str, name: str) -> str:
    return title_sql(f"lower(coalesce(nullif({alt}, ''), nullif({name}, ''), '?'))")


def _pct(num: str) -> str:
    return f"CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE {Q.rnd(f'({num})::DOUBLE / total * 100.0::DOUBLE', 1)} END"


def _colour_sql(pct: str, flt: str) -> str:
    cuts, cols = C.COLOUR_RAMPS[flt]
    whens = " ".join(f"WHEN {pct} <= {t} THEN '{c}'" for t, c in zip(cuts, cols))
    return f"CASE WHEN total = 0 THEN '{C.NO_DATA_COLOUR}' {whens} ELSE '{cols[-1]}' END"


def map_ctes() -> str:
    cnt = ", ".join(f"CASE WHEN p.total IS NULL THEN coalesce(a.{c}, 0) ELSE p.{c} END AS {c}" for c in villages.COUNTS)
    return ",\n".join([
        _rank_sql(),
        Q.boundary_cte(),
        "people AS (SELECT result.*, coalesce(ranked.risk_level, 'Sedang') AS risk_level, "
        f"{norm_sql('desa', 'NAN')} AS desa_norm FROM result LEFT JOIN ranked USING (cluster))",
        "vc AS (SELECT desa_norm, count(*) FILTER (WHERE risk_level = 'Sehat') AS sehat, "
        "count(*) FILTER (WHERE risk_level = 'Sedang') AS sedang, count(*) FILTER (WHERE risk_level = 'Tinggi') "
        "AS tinggi, count(risk_level) AS total FROM people GROUP BY desa_norm)",
        f"vb AS (SELECT gid, desa_geo, alt_geo, {norm_sql('desa_geo', '')} AS name_norm, "
        f"{norm_sql('alt_geo', '')} AS alt_norm FROM village_boundary)",
        f"mg AS (SELECT vb.*, {cnt} FROM vb LEFT JOIN vc p ON p.desa_norm = vb.name_norm "
        "LEFT JOIN vc a ON a.desa_norm = vb.alt_norm)",
        f"mp AS (SELECT mg.*, {_pct('sehat')} AS pct_sehat, {_pct('sedang')} AS pct_sedang, "
        f"{_pct('tinggi')} AS pct_tinggi, {_pct('sedang + tinggi')} AS pct_risiko FROM mg)",
    ])


def with_map(select: str) -> str:
    return Q.with_lloyd(select, map_ctes())


def risk_map(spark, sf, risk_filter="all"):
    res = clustered(spark, sf)
    return riskmap.village_risk_map(res.labelled, village_boundary(spark, sf), risk_filter)


MAP_COLS = ["gid", "desa_geo", "alt_geo", "name_norm", "alt_norm", "sehat", "sedang", "tinggi", "total",
            "pct_sehat", "pct_sedang", "pct_tinggi", "pct_risiko", "fill_color", "display_name"]


@register("k25_village_risk_map", with_map(
    f"SELECT gid, desa_geo, alt_geo, name_norm, alt_norm, sehat, sedang, tinggi, total, pct_sehat, pct_sedang, "
    f"pct_tinggi, pct_risiko, {_colour_sql('pct_risiko', 'all')} AS fill_color, "
    f"{display_sql('alt_geo', 'desa_geo')} AS display_name FROM mp"))
def k25(spark, sf):
    return risk_map(spark, sf).mapped.select(*MAP_COLS)


@register("f10_risk_filter_colours", with_map(
    "SELECT gid, " + ", ".join(
        f"{_colour_sql(risk.pct_column_for(flt), flt)} AS fill_{flt}" for flt in ("all", "sehat", "sedang", "tinggi"))
    + " FROM mp"))
def f10(spark, sf):
    m = risk_map(spark, sf).mapped
    return m.select("gid", *[risk.village_colour(risk.pct_column_for(f), "total", f).alias(f"fill_{f}")
                             for f in ("all", "sehat", "sedang", "tinggi")])


@register("j04_boundaries_without_data", with_map("SELECT gid, desa_geo, alt_geo FROM mp WHERE total = 0"))
def j04(spark, sf):
    return villages.boundaries_without_data(risk_map(spark, sf).mapped).select("gid", "desa_geo", "alt_geo")


@register("j05_villages_without_boundary", with_map(
    "SELECT desa_norm, total FROM vc WHERE desa_norm NOT IN (SELECT name_norm FROM vb UNION SELECT alt_norm FROM vb)"))
def j05(spark, sf):
    """Names and totals need the cleaned table only, not its clusters."""
    totals = villages.village_totals(clean(spark, sf, sort=False).table)
    return villages.villages_without_boundary(totals, villages.named(village_boundary(spark, sf)))


@register("j06_people_risk_level", with_map("SELECT row_id, cluster, risk_level FROM people"))
def j06(spark, sf):
    return risk_map(spark, sf).people.select("row_id", "cluster", "risk_level")


@register("a11_village_risk_counts", with_map("SELECT desa_norm, sehat, sedang, tinggi, total FROM vc"))
def a11(spark, sf):
    return risk_map(spark, sf).counts


@register("a11_village_risk_table", with_map(
    "SELECT desa, count(*) FILTER (WHERE risk_level = 'Sehat') AS sehat, count(*) FILTER (WHERE risk_level = 'Sedang') "
    "AS sedang, count(*) FILTER (WHERE risk_level = 'Tinggi') AS tinggi, count(risk_level) AS total, "
    "coalesce(" + Q.rnd("(count(*) FILTER (WHERE risk_level <> 'Sehat'))::DOUBLE / count(risk_level) * 100.0::DOUBLE", 1)
    + ", 0.0::DOUBLE) AS pct_risiko FROM people WHERE desa IS NOT NULL GROUP BY desa"))
def a11_table(spark, sf):
    return riskmap.village_table(risk_map(spark, sf).people)


@register("a11_risk_kpis", with_map(
    "SELECT count(*) AS total, count(*) FILTER (WHERE risk_level = 'Sehat') AS sehat, "
    "count(*) FILTER (WHERE risk_level = 'Sedang') AS sedang, count(*) FILTER (WHERE risk_level = 'Tinggi') AS tinggi "
    "FROM people"))
def a11_kpis(spark, sf):
    return riskmap.risk_kpis(risk_map(spark, sf).people)


@register("a10_village_cluster_crosstab", Q.with_lloyd(
    "SELECT coalesce(desa, 'Total') AS desa, count(*) FILTER (WHERE cluster = 0) AS cluster_0, "
    "count(*) FILTER (WHERE cluster = 1) AS cluster_1, count(*) FILTER (WHERE cluster = 2) AS cluster_2, "
    "count(*) AS total FROM result WHERE desa IS NOT NULL GROUP BY ROLLUP (desa)"))
def a10(spark, sf):
    from kohort.operators.stats import crosstab_with_totals
    return crosstab_with_totals(clustered(spark, sf).labelled, "desa", "cluster", list(range(3)))


# --- P19-P21, P26 ---------------------------------------------------------------
def _p19_sql():
    rules = [("umur >= 60", C.INDIVIDUAL_REASONS[0]), ("imt < 18.5", C.INDIVIDUAL_REASONS[1]),
             ("imt >= 27.0 AND NOT coalesce(imt < 18.5, false)", C.INDIVIDUAL_REASONS[2]),
             ("sistolik >= 140 OR diastolik >= 90", C.INDIVIDUAL_REASONS[3]),
             ("gds_1 >= 140", C.INDIVIDUAL_REASONS[4]), ("kolesterol >= 200", C.INDIVIDUAL_REASONS[5])]
    flags = [f"coalesce(({cond}), false)" for cond, _ in rules]
    score = " + ".join(f"{f}::INT" for f in flags)
    reasons = "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {f} THEN '{t}' END" for f, (_, t) in zip(flags, rules)) + "], lambda x: x IS NOT NULL), '; ')"
    return Q.with_clean(
        f"SELECT row_id, risk_score, CASE WHEN risk_score >= 3 THEN 'Tinggi' WHEN risk_score >= 1 THEN 'Sedang' "
        f"ELSE 'Sehat' END AS risk_level, CASE WHEN risk_score >= 3 THEN 'danger' WHEN risk_score >= 1 THEN 'warning' "
        f"ELSE 'success' END AS risk_color, risk_reasons FROM (SELECT row_id, ({score}) AS risk_score, "
        f"{reasons} AS risk_reasons FROM clean)")


@register("p19_individual_risk", _p19_sql())
def p19(spark, sf):
    t = clean(spark, sf, sort=False).table
    cols = risk.individual_risk()
    return t.select("row_id", *[v.alias(k) for k, v in cols.items()])


@register("p20_village_name_normalise", Q.with_clean(
    f"SELECT row_id, desa, {norm_sql('desa', '')} AS desa_norm FROM clean"))
def p20(spark, sf):
    t = clean(spark, sf, sort=False).table
    return t.select("row_id", "desa", text.normalise_village("desa").alias("desa_norm"))


@register("p20_raw_village_normalise", "WITH " + Q.raw_cte() +
          f"\nSELECT row_id, {norm_sql('desa', '')} AS desa_norm FROM raw")
def p20_raw(spark, sf):
    return raw_screening(spark, sf).select("row_id", text.normalise_village("desa").alias("desa_norm"))


@register("p26_display_name", "WITH " + Q.boundary_cte() +
          f"\nSELECT gid, {display_sql('alt_geo', 'desa_geo')} AS display_name, "
          f"{display_sql('desa_geo', 'alt_geo')} AS display_name_primary FROM village_boundary")
def p26(spark, sf):
    b = village_boundary(spark, sf)
    return b.select("gid", text.display_name("alt_geo", "desa_geo").alias("display_name"),
                    text.display_name("desa_geo", "alt_geo").alias("display_name_primary"))


@register("p21_village_colour", with_map(
    f"SELECT gid, pct_risiko, {_colour_sql('pct_risiko', 'all')} AS fill_color FROM mp"))
def p21(spark, sf):
    m = risk_map(spark, sf).mapped
    return m.select("gid", "pct_risiko", F.col("fill_color"))


# --- J01-J03 and U01 as their own queries -------------------------------------------
@register("j01_primary_name_join", with_map(
    "SELECT vb.gid, vb.name_norm, p.sehat, p.sedang, p.tinggi, p.total FROM vb LEFT JOIN vc p "
    "ON p.desa_norm = vb.name_norm"))
def j01(spark, sf):
    primary = F.col("matched_by") == "primary"
    return risk_map(spark, sf).mapped.select("gid", "name_norm", *[F.when(primary, F.col(c)).alias(c) for c in villages.COUNTS])


@register("j02_alternate_name_fallback", with_map(
    "SELECT vb.gid, vb.alt_norm, a.total FROM vb LEFT JOIN vc p ON p.desa_norm = vb.name_norm "
    "JOIN vc a ON a.desa_norm = vb.alt_norm WHERE p.total IS NULL"))
def j02(spark, sf):
    return risk_map(spark, sf).mapped.where(F.col("matched_by") == "alternate").select("gid", "alt_norm", "total")


@register("j03_village_percentages", with_map(
    "SELECT gid, sehat, sedang, tinggi, total, pct_sehat, pct_sedang, pct_tinggi, pct_risiko FROM mp"))
def j03(spark, sf):
    return risk_map(spark, sf).mapped.select("gid", *villages.COUNTS, "pct_sehat", "pct_sedang", "pct_tinggi",
                                             "pct_risiko")


@register("u01_boundary_names", "WITH " + Q.boundary_cte() +
          f"\nSELECT {norm_sql('desa_geo', '')} AS name FROM village_boundary UNION "
          f"SELECT {norm_sql('alt_geo', '')} AS name FROM village_boundary")
def u01(spark, sf):
    b = village_boundary(spark, sf)
    return (b.select(text.normalise_village("desa_geo").alias("name"))
             .union(b.select(text.normalise_village("alt_geo").alias("name"))).distinct())


@register("w02_cluster_rank", Q.with_lloyd(
    "SELECT cluster, risk_score, r AS risk_rank, risk_label FROM rk JOIN ranked USING (cluster, risk_score)",
    _rank_sql()))
def w02(spark, sf):
    from pyspark.sql import Window
    _, ranked = ranked_clusters(spark, sf)
    w = Window.orderBy(F.col("risk_score").asc(), F.col("cluster").asc())
    return ranked.select("cluster", "risk_score", F.row_number().over(w).alias("risk_rank"), "risk_label")
