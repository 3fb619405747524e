"""Risk rules as Column expressions: individual risk (P19), composite cluster score
(K15), interpretation tags (K17), report conclusion (K19), quality bands (K20) and
choropleth classes (P21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kohort import config as C
from kohort.functions.text import _col


def individual_risk(age="umur", bmi="imt", systolic="sistolik", diastolic="diastolik",
                    glucose="gds_1", cholesterol="kolesterol") -> dict[str, Column]:
    """+1 per rule; level and colour from the score; ordered reasons joined by '; '.

    Column names are parameters; the defaults are the cleaned table's names.
    """
    a, b, s, d, g, ch = (_col(x) for x in (age, bmi, systolic, diastolic, glucose, cholesterol))
    r_age = F.coalesce(a >= 60, F.lit(False))
    r_under = F.coalesce(b < 18.5, F.lit(False))
    r_over = F.coalesce(b >= 27.0, F.lit(False)) & ~r_under
    r_bp = F.coalesce(s >= 140, F.lit(False)) | F.coalesce(d >= 90, F.lit(False))
    r_glu = F.coalesce(g >= 140, F.lit(False))
    r_chol = F.coalesce(ch >= 200, F.lit(False))
    rules = [r_age, r_under, r_over, r_bp, r_glu, r_chol]
    score = sum((r.cast("int") for r in rules), F.lit(0))
    level = F.when(score >= 3, "Tinggi").when(score >= 1, "Sedang").otherwise("Sehat")
    colour = F.when(score >= 3, "danger").when(score >= 1, "warning").otherwise("success")
    reasons = F.array_compact(F.array(*[F.when(r, F.lit(t)) for r, t in zip(rules, C.INDIVIDUAL_REASONS)]))
    return {"risk_score": score, "risk_level": level, "risk_color": colour,
            "risk_reasons": F.array_join(reasons, "; ")}


def _rule(x: Column, op: str, t: float) -> Column:
    return x >= t if op == ">=" else x < t


def cluster_risk_score(present: list[str] | None = None, prefix: str = "") -> Column:
    """Composite score of one row of (cluster) means, rounded to 3 places.

    Features not in ``present`` add nothing; a NULL mean adds nothing either.
    """
    present = list(C.RISK_SCORE_RULES) if present is None else present
    total = F.lit(0.0)
    for feat, steps in C.RISK_SCORE_RULES.items():
        if feat not in present:
            continue
        x = F.col(prefix + feat)
        expr = None
        for rules, pts in steps:
            cond = None
            for op, t in rules:
                r = _rule(x, op, t)
                cond = r if cond is None else (cond | r)
            expr = F.when(cond, F.lit(pts)) if expr is None else expr.when(cond, F.lit(pts))
        total = total + F.coalesce(expr.otherwise(F.lit(0.0)), F.lit(0.0))
    return F.round(total, 3)


def interpret_tag(feat: str, c=None) -> Column:
    """Descriptive tag of a cluster mean."""
    x = F.col(feat) if c is None else _col(c)
    cuts, fallback = C.INTERPRET_TAGS[feat]
    out = None
    for t, tag in cuts:
        out = F.when(x >= t, F.lit(tag)) if out is None else out.when(x >= t, F.lit(tag))
    return out.otherwise(F.lit(fallback))


def interpretation_lines(features: list[str], label="risk_label") -> Column:
    """The text of one cluster, a line per feature of its means and one for the conclusion."""
    lines = [F.concat(F.lit(head), F.format_string(f"%.{digits}f", F.round(F.col(f), digits)), F.lit(f"{unit} ("), interpret_tag(f), F.lit(")"))
             for f, (head, digits, unit) in C.INTERPRET_LINES.items() if f in features]
    notes = F.create_map(*[x for k, v in C.RISK_NOTES.items() for x in (F.lit(k), F.lit(v))])
    lines.append(F.concat(F.lit(C.INTERPRET_CONCLUSION), _col(label), F.lit(" "), notes[_col(label)]))
    return F.concat_ws("\n", *lines)


def report_conclusion(age="umur", bmi="imt", systolic="sistolik", cholesterol="kolesterol",
                      glucose="gds_1") -> Column:
    """+1 each on (2-place rounded) cluster means; >=3 Tinggi, >=1 Sedang, else Rendah."""
    a, b, s, ch, g = (_col(x) for x in (age, bmi, systolic, cholesterol, glucose))
    conds = [a >= 70, (b >= 30) | (b < 18.5), s >= 140, ch >= 200, g >= 140]
    score = sum((F.coalesce(c, F.lit(False)).cast("int") for c in conds), F.lit(0))
    hi, mid, lo = C.REPORT_LEVELS
    return F.when(score >= 3, hi).when(score >= 1, mid).otherwise(lo)


def metric_texts(metric) -> Column:
    """Metric name -> struct (explanation, formula, strengths, weaknesses) of the evaluation page; null for others."""
    out = None
    for name, (explanation, formula, good, bad) in C.METRIC_TEXTS.items():
        texts = F.struct(F.lit(explanation).alias("explanation"), F.lit(formula).alias("formula"),
                         F.array(*map(F.lit, good)).alias("strengths"), F.array(*map(F.lit, bad)).alias("weaknesses"))
        out = F.when(_col(metric) == name, texts) if out is None else out.when(_col(metric) == name, texts)
    return out


def quality_band(c, metric: str, cuts: tuple | None = None, labels: tuple = C.BAND_LABELS) -> Column:
    """Metric value -> quality label. Silhouette/CH: higher is better; DBI: lower."""
    x = _col(c)
    if cuts is None:
        cuts = {"silhouette": C.SILHOUETTE_CUTS, "dbi": C.DBI_CUTS, "ch": C.CH_CUTS}[metric]
    lower_better = metric == "dbi"
    out = None
    for t, lab in zip(cuts, labels):
        cond = x <= t if lower_better else x >= t
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out.otherwise(F.lit(labels[len(cuts)]))


def village_colour(pct, total, risk_filter: str = "all") -> Column:
    """Choropleth class; villages without data get the neutral colour."""
    f = str(risk_filter).lower().strip()
    cuts, colours = C.COLOUR_RAMPS.get(f, C.COLOUR_RAMPS["all"])
    p = _col(pct)
    out = F.when(_col(total) == 0, F.lit(C.NO_DATA_COLOUR))
    for t, col in zip(cuts, colours):
        out = out.when(p <= t, F.lit(col))
    return out.otherwise(F.lit(colours[-1]))


def pct_column_for(risk_filter: str) -> str:
    """which percentage a risk filter reads (sehat/sedang/tinggi, anything else = all)."""
    f = str(risk_filter).lower().strip()
    return {"sehat": "pct_sehat", "sedang": "pct_sedang", "tinggi": "pct_tinggi"}.get(f, "pct_risiko")


def recommendations(label="risk_label", age="umur", bmi="imt", systolic="sistolik", glucose="gds_1",
                    cholesterol="kolesterol", uric=None, present: list[str] | None = None) -> Column:
    """Ordered advice list from cluster means, then one general line per level.

    Column names are parameters (defaults are the cleaned table's names, so every
    branch can fire); a feature missing from ``present`` contributes nothing.
    """
    have = (lambda c: c is not None and (present is None or c in present))
    items = []
    if have(age):
        a = F.col(age)
        items.append(F.when(a >= 70, F.lit(C.REC_AGE_70)).when(a >= 60, F.lit(C.REC_AGE_60)))
    if have(bmi):
        b = F.col(bmi)
        items.append(F.when(b >= 30, F.lit(C.REC_BMI_30)).when(b >= 25, F.lit(C.REC_BMI_25))
                     .when(b < 18.5, F.lit(C.REC_BMI_UNDER)))
    if have(systolic):
        s = F.col(systolic)
        items.append(F.when(s >= 140, F.lit(C.REC_SYS_140)).when(s >= 120, F.lit(C.REC_SYS_120)))
    if have(glucose):
        g = F.col(glucose)
        items.append(F.when(g >= 200, F.lit(C.REC_GLU_200)).when(g >= 140, F.lit(C.REC_GLU_140))
                     .when(g >= 100, F.lit(C.REC_GLU_100)))
    if have(cholesterol):
        items.append(F.when(F.col(cholesterol) >= 200, F.lit(C.REC_CHOL_200)))
    if have(uric):
        items.append(F.when(F.col(uric) >= 7.0, F.lit(C.REC_URIC_7)))
    lab = _col(label)
    general = F.when(lab == "RISIKO TINGGI", F.lit(C.REC_GENERAL["RISIKO TINGGI"])) \
        .when(lab == "RISIKO SEDANG", F.lit(C.REC_GENERAL["RISIKO SEDANG"])) \
        .otherwise(F.lit(C.REC_GENERAL["RELATIF SEHAT"]))
    return F.array_compact(F.array(*items, general))


def level_meta(label="risk_label") -> dict[str, Column]:
    """Display level, colour and description of a relative risk label."""
    def of(i):
        return F.create_map(*[x for k, v in C.LEVEL_META.items() for x in (F.lit(k), F.lit(v[i]))])[_col(label)]
    return {"level": of(0), "color": of(1), "description": of(2)}


def console_band(c, metric: str) -> Column:
    """The text report's bands (silhouette higher is better, DBI lower)."""
    x = _col(c)
    table = C.CONSOLE_SILHOUETTE if metric == "silhouette" else C.CONSOLE_DBI
    out = None
    for cut, text in table:
        if cut is None:
            return out.otherwise(F.lit(text))
        cond = x >= cut if metric == "silhouette" else x <= cut
        out = F.when(cond, F.lit(text)) if out is None else out.when(cond, F.lit(text))
    return out
