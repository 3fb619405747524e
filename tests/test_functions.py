"""Column functions against the hand-derived edge cases (FIXTURES section 5)."""

from pyspark.sql import functions as F

from kohort.functions import encode, geo, measures, risk, text


def one(spark, col, rows, schema="x string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col.alias("y")).collect()]


def test_p01_clean_text(spark):
    got = one(spark, text.clean_text("x"), [(" nan ",), ("NaN",), ("\tA\n",), ("None",), (None,), ("",)])
    assert got == [None, "NaN", "A", None, None, None]


def test_p02_numeric_text(spark):
    got = one(spark, text.numeric_text("x"), [("120/80",), ("5,5",), ("1.2.3",), ("-",), ("5.",), ("70 kg",), ("",)])
    assert got == [12080.0, 55.0, None, None, 5.0, 70.0, None]


def test_p03_zero_as_null(spark):
    assert one(spark, measures.zero_as_null("x"), [(0.0,), (5.0,)], "x double") == [None, 5.0]


def test_p05_age(spark):
    rows = [("1985-06-15",), ("1986-01-01",), ("1905-02-02",), ("1904-12-31",), ("tidak diketahui",)]
    got = one(spark, measures.age(measures.parse_date("x"), 2025), rows)
    assert got == [40.0, None, 120.0, None, None]


def test_p06_bmi(spark):
    rows = [(60.0, 160.0), (60.0, 0.0), (25.0, 170.0), (0.0, 0.0)]
    got = one(spark, measures.bmi("w", "h"), rows, "w double, h double")
    assert got == [23.44, None, None, None]


def test_p07_to_p11_encoders(spark):
    assert one(spark, encode.sex("x"), [(" Laki-laki ",), ("laki-laki",), (None,)]) == [1, 0, 0]
    assert one(spark, encode.hypertension("x"), [("Ya",), ("Tidak ",), ("ya",)]) == [1, 0, None]
    assert one(spark, encode.cognitive("x"), [("Kemungkinan ada gangguan kognitif",), ("Tidak ada gangguan",),
                                              ("ada gangguan, tidak berat",)]) == [1, 0, None]
    assert one(spark, encode.malnutrition("x"), [("Berisiko Malnutrisi",), ("Malnutrisi",), ("Malnutrisi normal",),
                                                 ("Berisiko, normal",), ("Status Gizi Normal",), ("x",)]) == \
        [1, 1, 0, 1, 0, None]
    assert one(spark, encode.depression("x"), [("Ada gejala depresi",), ("Tidak ada gejala",), ("ragu",), ("",),
                                               ("none",)]) == [1, 0, 1, None, None]


def test_p12_p13(spark):
    assert one(spark, encode.sex_code("x"), [("pr",), ("LAKI",), ("x",)]) == [0.0, 1.0, None]
    rows = [(None,), ("lama",), ("*",), ("3",), ("0.0",), ("abc",)]
    assert one(spark, encode.yes_no("x"), rows) == [0.0, 1.0, 1.0, 1.0, 0.0, 0.0]
    assert one(spark, encode.yes_no("x", visit=True), [("ya",), ("v",)]) == [0.0, 1.0]


def test_p14_bmi_from_text(spark):
    df = spark.createDataFrame([("20(N)", None, None), (None, "55", "158"), (None, "55", "1.58"), ("5", None, None)],
                               "v string, w string, h string")
    got = [r[0] for r in df.select(measures.bmi_from_text("v", "w", "h")).collect()]
    assert got == [20.0, 22.03, 22.03, None]


def test_p15_blood_pressure(spark):
    rows = [("120/80",), ("120-80",), ("138,77",), ("120",), ("abc",), ("120/x",), ("400/80",)]
    df = spark.createDataFrame(rows, "x string").select(measures.split_blood_pressure("x").alias("b"))
    got = [(r.b.sistolik, r.b.diastolik) for r in df.collect()]
    assert got == [(120.0, 80.0), (120.0, 80.0), (138.0, 77.0), (120.0, None), (None, None), (None, None),
                   (None, 80.0)]


def test_p16_range(spark):
    got = one(spark, measures.in_range("x", 60, 300), [(60.0,), (300.0,), (59.9,), (300.1,)], "x double")
    assert got == [60.0, 300.0, None, None]


def test_p19_individual_risk(spark):
    df = spark.createDataFrame([(60.0, 27.0, 139.0, 90.0, 139.0, None), (None,) * 6, (60.0, None, None, None, None, None)],
                               "umur double, imt double, sistolik double, diastolik double, gds_1 double, kolesterol double")
    cols = risk.individual_risk()
    got = [(r.risk_score, r.risk_level) for r in df.select(*[v.alias(k) for k, v in cols.items()]).collect()]
    assert got == [(3, "Tinggi"), (0, "Sehat"), (1, "Sedang")]


def test_p20_village_name(spark):
    assert one(spark, text.normalise_village("x"), [("  suger   lor ",), (None,)]) == ["SUGER LOR", ""]
    assert one(spark, text.normalise_village("x", null_as="NAN"), [(None,)]) == ["NAN"]


def test_p21_colour(spark):
    df = spark.createDataFrame([(15.0, 3), (15.1, 3), (75.1, 3), (10.0, 0)], "p double, t long")
    got = [r[0] for r in df.select(risk.village_colour("p", "t", "all")).collect()]
    assert got == ["#10b981", "#84cc16", "#ef4444", "#e2e8f0"]
    got = [r[0] for r in df.select(risk.village_colour("p", "t", "tinggi")).collect()]
    assert got[0] == "#fee2e2" and spark.createDataFrame([(10.0, 1)], "p double, t long").select(
        risk.village_colour("p", "t", "tinggi")).first()[0] == "#fef2f2"


def test_p22_vertex_centroid(spark):
    rows = [("Polygon", "[[[0,0],[2,0],[2,2],[0,0]]]"), ("Point", "[113.7,-8.0]"), ("LineString", "[[0,0],[1,1]]")]
    df = spark.createDataFrame(rows, "t string, c string").select(geo.vertex_centroid("t", "c").alias("p"))
    got = [None if r.p is None else (r.p.lat, r.p.lon) for r in df.collect()]
    assert got == [(0.5, 1.0), (-8.0, 113.7), None]


def test_p26_title_case(spark):
    got = one(spark, text.display_name("a", "b"), [("suger-lor", "x"), ("", "old nation_4"), (None, None)],
              "a string, b string")
    assert got == ["Suger-Lor", "Old Nation_4", "?"]


def test_s03_clean_header():
    assert text.clean_header("Jenis Kelamin") == "jenis_kelamin"
    assert text.clean_header("Gangguan\nGinjal") == "gangguan_ginjal"
    assert text.clean_header("TD (mmHg)") == "td_mmhg"


def test_s06_month(spark):
    got = one(spark, text.month_of("x"), [("laporan_Januari_2026.csv",), ("AGUSTUS",), ("lain",)])
    assert got == ["Januari", "Agustus", None]


def test_s07_nan_to_null(spark):
    got = one(spark, text.nan_to_null("x"), [(float("nan"),), (float("inf"),), (1.5,)], "x double")
    assert got == [None, None, 1.5]


def test_k15_score(spark):
    df = spark.createDataFrame([(70.0, 25.0, 140.0, 90.0, 126.0, 200.0), (None,) * 6],
                               "umur double, imt double, sistolik double, diastolik double, gds_1 double, kolesterol double")
    assert [r[0] for r in df.select(risk.cluster_risk_score()).collect()] == [7.5, 0.0]


def test_k20_bands(spark):
    df = spark.createDataFrame([(0.7, 0.5, 500.0), (0.3, 2.5, 99.0)], "s double, d double, c double")
    got = df.select(risk.quality_band("s", "silhouette"), risk.quality_band("d", "dbi"),
                    risk.quality_band("c", "ch")).collect()
    assert [tuple(r) for r in got] == [("Sangat Baik", "Sangat Baik", "Sangat Baik"), ("Cukup", "Kurang", "Kurang")]


def test_no_python_udf_in_cleaning_plan(spark):
    from tests.conftest import SF001
    import __spark_entry__ as E
    plan = E.queries()["k24_clean_table"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
