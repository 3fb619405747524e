"""DuckDB SQL fragments for the oracle: the same semantics written independently
as plain SQL over the pre-registered tables (never executed by Spark)."""

from __future__ import annotations

from kohort import config as C
from kohort.sources.tables import RAW_SCREENING_SQL, UPLOAD_BATCH_SQL, VILLAGE_BOUNDARY_SQL, oracle_view

WS = "(" + "||".join(f"chr({ord(ch)})" for ch in C.WHITESPACE) + ")"
DISTRICT = "ASIA"
AS_OF = 2025


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rnd(x: str, d: int) -> str:
    """Round half away from zero on the shortest decimal text of the double
    (what Spark's round does), not on the binary value times 10^d."""
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def clean_text(x: str) -> str:
    return f"CASE WHEN {strip(x)} IN ('nan', 'None', '') THEN NULL ELSE {strip(x)} END"


def numeric(x: str) -> str:
    return f"TRY_CAST(regexp_replace(CAST({x} AS VARCHAR), '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def has(x: str, s: str) -> str:
    return f"contains({x}, '{s}')"


def enc_sex(x):
    return f"CASE WHEN {strip(x)} = 'Laki-laki' THEN 1 ELSE 0 END"


def enc_ht(x):
    return f"CASE WHEN {strip(x)} = 'Ya' THEN 1 WHEN {strip(x)} = 'Tidak' THEN 0 END"


def enc_cog(x):
    s = f"lower({strip(x)})"
    return (f"CASE WHEN {has(s, 'ada gangguan')} AND NOT {has(s, 'tidak')} THEN 1 "
            f"WHEN {has(s, 'tidak ada gangguan')} THEN 0 END")


def enc_mal(x):
    s = f"lower({strip(x)})"
    return (f"CASE WHEN {has(s, 'berisiko')} OR ({has(s, 'malnutrisi')} AND NOT {has(s, 'normal')}) THEN 1 "
            f"WHEN {has(s, 'normal')} THEN 0 END")


def enc_dep(x):
    s = f"lower({strip(x)})"
    return (f"CASE WHEN {x} IS NULL OR {s} IN ('nan', 'none', '') THEN NULL "
            f"WHEN {has(s, 'ada')} AND NOT {has(s, 'tidak')} THEN 1 WHEN {has(s, 'tidak')} THEN 0 ELSE 1 END")


def age(d, as_of=AS_OF):
    a = f"CAST({as_of} - year({d}) AS DOUBLE)"
    return f"CASE WHEN {a} BETWEEN 40 AND 120 THEN {a} END"


def bmi(w, h):
    hm = f"({h} / 100.0::DOUBLE)"
    v = rnd(f"CASE WHEN {hm} * {hm} = 0 THEN NULL ELSE {w} / ({hm} * {hm}) END", 2)
    return f"CASE WHEN {v} BETWEEN 10 AND 60 THEN {v} END"


FEATURES = C.FEATURES


def raw_cte() -> str:
    return f"raw AS ({oracle_view(RAW_SCREENING_SQL)})"


def boundary_cte() -> str:
    return f"village_boundary AS ({oracle_view(VILLAGE_BOUNDARY_SQL)})"


def batch_cte() -> str:
    return f"upload_batch AS ({oracle_view(UPLOAD_BATCH_SQL)})"


def values_cte(src: str = "raw") -> str:
    """P01-P04 over the raw view."""
    cols = ["row_id"]
    for c in C.RAW_COLUMNS:
        if c in C.STRING_COLUMNS:
            cols.append(f"{clean_text(c)} AS {c}")
        elif c in C.NUMERIC_TEXT_COLUMNS:
            v = numeric(c)
            cols.append(f"{'nullif(' + v + ', 0)' if c in C.GLUCOSE_COLUMNS else v} AS {c}")
        elif c == "tanggal_lahir":
            cols.append("TRY_CAST(tanggal_lahir AS DATE) AS tanggal_lahir")
        else:
            cols.append(c)
    return f"vals AS (SELECT {', '.join(cols)} FROM {src})"


def encoded_cte(district: str = DISTRICT, as_of: int = AS_OF) -> str:
    """F02 dedup, F01 filter, P05/P06, P07-P11."""
    return f"""dedup AS (SELECT * FROM vals QUALIFY row_number() OVER (PARTITION BY nik ORDER BY row_id) = 1),
filt AS (SELECT * FROM dedup WHERE upper({strip('kecamatan')}) = '{district}'),
enc AS (SELECT row_id, kecamatan, desa, nik, nama, {enc_sex('jenis_kelamin')} AS jenis_kelamin,
  berat_badan, tinggi_badan, {enc_ht('riwayat_hipertensi')} AS riwayat_hipertensi, sistolik, diastolik,
  gds_1, gds_2, gdp, gd2pp, {enc_cog('gangguan_kognitif')} AS gangguan_kognitif,
  {enc_mal('malnutrisi')} AS malnutrisi, {enc_dep('depresi')} AS depresi, kolesterol, tanggal_lahir,
  {age('tanggal_lahir', as_of)} AS umur, {bmi('berat_badan', 'tinggi_badan')} AS imt
  FROM filt)"""


def missing_cte(col_thr=C.COL_MISSING_THRESHOLD, row_thr=C.ROW_MISSING_THRESHOLD) -> str:
    """F03 ratios, F04 keep flags, F05 row filter (data-driven, as in Spark)."""
    ratios = ", ".join(f"coalesce(avg(CASE WHEN {f} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0) AS {f}"
                       for f in FEATURES)
    keep = ", ".join(f"CASE WHEN {f} > {col_thr} THEN 0 ELSE 1 END AS k_{f}" for f in FEATURES)
    nulls = " + ".join(f"(CASE WHEN enc.{f} IS NULL THEN keep.k_{f} ELSE 0 END)" for f in FEATURES)
    n = " + ".join(f"keep.k_{f}" for f in FEATURES)
    return f"""ratios AS (SELECT {ratios} FROM enc),
keep AS (SELECT {keep} FROM ratios),
rowf AS (SELECT enc.* FROM enc, keep WHERE ({nulls}) / CAST(({n}) AS DOUBLE) <= {row_thr})"""


def validated_cte() -> str:
    cols = ["row_id", "kecamatan", "desa", "nik", "nama"]
    for c in C.RAW_COLUMNS[4:] + ["umur", "imt"]:
        if c == "tanggal_lahir":
            continue
        if c in C.RANGE_RULES:
            lo, hi = C.RANGE_RULES[c]
            cols.append(f"CASE WHEN CAST({c} AS DOUBLE) BETWEEN {lo} AND {hi} THEN CAST({c} AS DOUBLE) END AS {c}")
        elif c in C.BINARY_COLUMNS:
            cols.append(f"CASE WHEN {c} IN (0, 1) THEN {c} END AS {c}")
        else:
            cols.append(f"CAST({c} AS DOUBLE) AS {c}")
    return f"valid AS (SELECT {', '.join(cols)} FROM rowf)"


# Columns of the cleaned table on the sf0.01 fixture (F04 drops gds_2 there).
CLEAN_COLUMNS = ["row_id", "kecamatan", "desa", "nik", "nama", "jenis_kelamin", "berat_badan",
                 "tinggi_badan", "riwayat_hipertensi", "sistolik", "diastolik", "gds_1", "gdp",
                 "gd2pp", "gangguan_kognitif", "malnutrisi", "depresi", "kolesterol", "umur", "imt"]
CLEAN_FEATURES = [f for f in FEATURES if f in CLEAN_COLUMNS]


def clean_ctes(district: str = DISTRICT) -> str:
    """All CTEs up to ``clean`` (the K24 table on the fixture)."""
    return ",\n".join([raw_cte(), values_cte(), encoded_cte(district), missing_cte(), validated_cte(),
                       f"clean AS (SELECT {', '.join(CLEAN_COLUMNS)} FROM valid)"])


def with_clean(select: str, *extra_ctes: str) -> str:
    ctes = [clean_ctes()] + list(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- K01 scaling and K03 Lloyd ------------------------------------------------

def scaled_cte(src: str = "clean", present: list[str] | None = None) -> str:
    """K01 over ``src``: absent features are constant 0.0; median fill; min-max; constant -> 0."""
    present = CLEAN_FEATURES if present is None else present
    med = ", ".join(f"coalesce(quantile_cont({f}, 0.5), 0) AS med_{f}, coalesce(min({f}), 0) AS mn_{f}, "
                    f"coalesce(max({f}), 0) AS mx_{f}" for f in present)
    cols = []
    for f in FEATURES:
        if f in present:
            x = f"coalesce(CAST({src}.{f} AS DOUBLE), fit.med_{f})"
            cols.append(f"CASE WHEN fit.mx_{f} - fit.mn_{f} = 0 THEN 0.0::DOUBLE "
                        f"ELSE ({x} - fit.mn_{f}) / (fit.mx_{f} - fit.mn_{f}) END AS s_{f}")
        else:
            cols.append(f"0.0::DOUBLE AS s_{f}")
    return (f"fit AS (SELECT {med} FROM {src}),\n"
            f"scaled AS (SELECT {src}.*, {', '.join(cols)} FROM {src}, fit)")


def lloyd_ctes(k: int = 3, iterations: int = 5, dist_digits: int = 4, cent_digits: int = 9) -> str:
    """K03 unrolled: c0 = first k rows by row_id; a_i assigns against c_{i-1}; c_i = rounded means."""
    s = [f"s_{f}" for f in FEATURES]
    out = [f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS INTEGER) AS cluster, {', '.join(s)} "
           f"FROM (SELECT * FROM scaled ORDER BY row_id LIMIT {k}))"]
    for it in range(1, iterations + 1):
        dist = "sqrt(0.0::DOUBLE + " + " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in s) + ")"
        out.append(f"a{it} AS (SELECT p.row_id, first(c.cluster ORDER BY {rnd(dist, dist_digits)}, c.cluster) AS cluster "
                   f"FROM scaled p, c{it - 1} c GROUP BY p.row_id)")
        means = ", ".join(f"coalesce({rnd(f'avg(x.{c})', cent_digits)}, o.{c}) AS {c}" for c in s)
        out.append(f"c{it} AS (SELECT o.cluster, {means} FROM c{it - 1} o LEFT JOIN "
                   f"(SELECT a.cluster, p.* EXCLUDE (row_id) FROM a{it} a JOIN scaled p USING (row_id)) x "
                   f"ON x.cluster = o.cluster GROUP BY o.cluster, {', '.join('o.' + c for c in s)})")
    out.append(f"labels AS (SELECT row_id, cluster FROM a{iterations})")
    out.append(f"centres AS (SELECT * FROM c{iterations})")
    absent = "".join(f", 0.0::DOUBLE AS {f}" for f in FEATURES if f not in CLEAN_COLUMNS)
    out.append(f"result AS (SELECT clean.*{absent}, labels.cluster FROM clean JOIN labels USING (row_id))")
    return ",\n".join(out)


def with_lloyd(select: str, *extra: str) -> str:
    return with_clean(select, scaled_cte(), lloyd_ctes(), *extra)


def risk_score_sql(without: tuple = ()) -> str:
    """K15 on a row of means (absent/NULL features add 0), rounded to 3."""
    terms = []
    for feat, steps in C.RISK_SCORE_RULES.items():
        if feat in without:
            continue
        x = feat
        whens = []
        for rules, pts in steps:
            cond = " OR ".join(f"{x} {op} {t}" for op, t in rules)
            whens.append(f"WHEN {cond} THEN {pts}")
        terms.append(f"coalesce(CASE {' '.join(whens)} ELSE 0.0 END, 0.0)")
    return rnd("0.0::DOUBLE + " + " + ".join(terms), 3)


def py_float(x: str) -> str:
    """Python float() rules in DuckDB: '_' between digits dropped, Java-only suffixes rejected."""
    t = f"regexp_replace(regexp_replace({strip(x)}, '([0-9])_([0-9])', '\\1\\2', 'g'), '([0-9])_([0-9])', '\\1\\2', 'g')"
    bad = f"(regexp_matches({t}, '[dDfF]$') AND NOT regexp_matches(lower({t}), 'inf$')) OR regexp_matches({t}, '^[+-]?0[xX]')"
    return f"CASE WHEN {bad} THEN NULL ELSE TRY_CAST({t} AS DOUBLE) END"


# --- K02 / K04 / K05 K-Means with restarts ---------------------------------------

def kmeans_ctes(ks: list[int], restarts: int = 10, max_iter: int = 300, tol: float = 1e-4) -> str:
    """Over ``scaled``: k-means++ seeds by the hashed race, Lloyd for every (k, restart) as a recursion,
    and the best restart of each k: ``best`` (k, r, cost, steps), ``kcentres`` (k, cluster, s_...) and
    ``klabels`` (k, row_id, cluster)."""
    s = [f"s_{f}" for f in FEATURES]
    cols = ", ".join(s)

    def d2(p, c):
        return "(0.0::DOUBLE + " + " + ".join(f"({p}.{x} - {c}.{x}) * ({p}.{x} - {c}.{x})" for x in s) + ")"

    def race(step, near):
        u = f"((('0x' || substr(md5(p.row_id || '|' || rr.r || '|' || {step}), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)"
        return f"-ln({u}) / {near}"

    out = [f"pts AS MATERIALIZED (SELECT row_id, {cols} FROM scaled)",
           f"rr AS (SELECT unnest(range({restarts}))::INTEGER AS r)",
           f"still AS (SELECT {tol}::DOUBLE * ({' + '.join(f'coalesce(var_pop({x}), 0)' for x in s)}) / {len(s)} AS still FROM pts)"]
    for step in range(max(ks)):
        near = "1.0::DOUBLE" if step == 0 else "n.near"
        source = "pts p, rr" if step == 0 else f"near{step - 1} n JOIN pts p USING (row_id) JOIN rr USING (r)"
        where = "" if step == 0 else "WHERE n.near > 0"
        out.append(f"seed{step} AS MATERIALIZED (SELECT rr.r, p.row_id FROM {source} {where} "
                   f"QUALIFY row_number() OVER (PARTITION BY rr.r ORDER BY {race(step, near)}, p.row_id) = 1)")
        d = d2("p", "q")
        if step == 0:
            out.append(f"near0 AS MATERIALIZED (SELECT g.r, p.row_id, {d} AS near FROM pts p, seed0 g JOIN pts q ON q.row_id = g.row_id)")
        elif step + 1 < max(ks):
            out.append(f"near{step} AS MATERIALIZED (SELECT n.r, n.row_id, least(n.near, {d}) AS near FROM near{step - 1} n JOIN pts p USING (row_id) "
                       f"JOIN seed{step} g USING (r) JOIN pts q ON q.row_id = g.row_id)")
    seeds = " UNION ALL ".join(f"SELECT r, {i}::INTEGER AS cluster, row_id FROM seed{i}" for i in range(max(ks)))
    out.append(f"seeds AS ({seeds})")
    means = ", ".join(f"avg(p.{x}) AS {x}" for x in s)
    moved = " + ".join(f"(m.{x} - w.{x}) * (m.{x} - w.{x})" for x in s)
    new = ", ".join(f"coalesce({rnd(f'm.{x}', 9)}, w.{x}) AS {x}" for x in s)
    assign = (f"SELECT x.k, x.r, p.row_id, min({{'d': round({d2('p', 'x')}, 9), 'c': x.cluster}}).c AS cluster FROM pts p, km x "
              f"WHERE NOT x.rest AND x.it < {max_iter} GROUP BY x.k, x.r, p.row_id")
    out.append(f"""km AS (
SELECT 0 AS it, ks.k, g.r, g.cluster, {', '.join(f'p.{x}' for x in s)}, false AS rest
FROM (SELECT unnest([{', '.join(map(str, ks))}])::INTEGER AS k) ks JOIN seeds g ON g.cluster < ks.k JOIN pts p USING (row_id)
UNION ALL
SELECT it + 1, k, r, cluster, {cols}, sum(moved) OVER (PARTITION BY k, r) <= (SELECT still FROM still) AS rest
FROM (SELECT m.*, {moved} AS moved FROM (
  SELECT w.it, w.k, w.r, w.cluster, {new}
  FROM km w LEFT JOIN (SELECT a.k, a.r, a.cluster, {means} FROM ({assign}) a JOIN pts p USING (row_id) GROUP BY a.k, a.r, a.cluster) m USING (k, r, cluster)
  WHERE NOT w.rest AND w.it < {max_iter}) m JOIN km w USING (k, r, cluster)))""")
    out.append("fits AS MATERIALIZED (SELECT * FROM km QUALIFY it = max(it) OVER (PARTITION BY k, r))")
    out.append(f"near AS MATERIALIZED (SELECT x.k, x.r, p.row_id, min({{'d': round({d2('p', 'x')}, 9), 'c': x.cluster, 'e': {d2('p', 'x')}}}) AS n "
               "FROM pts p, fits x GROUP BY x.k, x.r, p.row_id)")
    out.append(f"best AS MATERIALIZED (SELECT k, r, cost FROM (SELECT k, r, {rnd('sum(n.e)', 6)} AS cost FROM near GROUP BY k, r) "
               "QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, r) = 1)")
    out.append(f"kcentres AS (SELECT k, cluster, {cols} FROM fits JOIN best USING (k, r))")
    out.append("klabels AS MATERIALIZED (SELECT k, row_id, n.c AS cluster FROM near JOIN best USING (k, r))")
    return ",\n".join(out)


def with_kmeans(select: str, ks: list[int], *extra: str) -> str:
    return with_clean(select, scaled_cte(), kmeans_ctes(ks), *extra).replace("WITH ", "WITH RECURSIVE ", 1)


# --- K11 PCA -----------------------------------------------------------------------

def pca_ctes(src: str = "scaled", squarings: int = 24) -> str:
    """The two leading components of the s_ columns: the covariance matrix is squared repeatedly, which
    leaves the projection on its leading eigenvector; the second one is that of the matrix without
    the first. ``pcs`` (pc, i, w, lambda), the largest loading positive; ``trace`` (t)."""
    s = [f"s_{f}" for f in FEATURES]
    cov = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, coalesce(covar_samp({a}, {b}), 0) AS v FROM {src}" for i, a in enumerate(s) for j, b in enumerate(s))
    out = [f"cov1 AS MATERIALIZED ({cov})", "trace AS (SELECT sum(v) AS t FROM cov1 WHERE i = j)"]
    for n in (1, 2):
        out.append(f"""sq{n} AS (SELECT 0 AS it, i, j, v FROM cov{n}
UNION ALL SELECT it, i, j, v / sqrt(sum(v * v) OVER ()) FROM (SELECT a.it + 1 AS it, a.i, b.j, sum(a.v * b.v) AS v FROM sq{n} a JOIN sq{n} b ON a.j = b.i WHERE a.it < {squarings} GROUP BY a.it, a.i, b.j))""")
        out.append(f"raw{n} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS w FROM sq{n} WHERE it = {squarings} AND j = (SELECT i FROM sq{n} WHERE it = {squarings} AND i = j ORDER BY v DESC, i LIMIT 1))")
        out.append(f"pc{n} AS MATERIALIZED (SELECT i, w * (SELECT sign(w) FROM raw{n} ORDER BY abs(w) DESC, i LIMIT 1) AS w FROM raw{n})")
        out.append(f"lam{n} AS MATERIALIZED (SELECT sum(a.w * c.v * b.w) AS l FROM cov{n} c JOIN pc{n} a ON a.i = c.i JOIN pc{n} b ON b.i = c.j)")
        if n == 1:
            out.append("cov2 AS MATERIALIZED (SELECT c.i, c.j, c.v - l * a.w * b.w AS v FROM cov1 c JOIN pc1 a ON a.i = c.i JOIN pc1 b ON b.i = c.j, lam1)")
    mean = ", ".join(f"avg({x}) AS {x}" for x in s)
    out.append(f"mid AS (SELECT {mean} FROM {src})")
    xs = [f"(" + " + ".join(f"(p.{x} - mid.{x}) * (SELECT w FROM pc{n} WHERE i = {i})" for i, x in enumerate(s)) + f") AS pc{n}" for n in (1, 2)]
    out.append(f"proj AS (SELECT p.row_id, {', '.join(xs)} FROM {src} p, mid)")
    return ",\n".join(out)


def with_pca(select: str) -> str:
    return with_lloyd(select, pca_ctes()).replace("WITH ", "WITH RECURSIVE ", 1)
