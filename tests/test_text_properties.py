"""The text functions against tables of rules, and properties that hold for random strings."""

import math
import re

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kohort.functions import encode, measures, text

ALPHABET = st.sampled_from(list("0123456789.-,/ abcNn\t\n\u00a0xX+eEdfi_") + ["nan", "None", "kg", "inf", "1e2"])
TEXTS = st.lists(ALPHABET, max_size=12).map("".join)


def py_clean_text(s):
    if s is None:
        return None
    t = s.strip()
    return None if t in ("nan", "None", "") else t


def py_numeric(s):
    if s is None:
        return None
    t = re.sub(r"[^0-9.\-]", "", s)
    if t in ("", "nan"):
        return None
    # a plain decimal: optional sign, digits with at most one point, at least one digit
    if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", t):
        return float(t)
    return None


def py_village(s):
    if s is None or s == "":
        return ""
    return " ".join(s.strip().upper().split())


# (text, systolic, diastolic): separators, missing and unreadable parts, bounds, number spellings
BLOOD_PRESSURE = [
    (None, None, None), ("", None, None), ("120/80", 120.0, 80.0), (" 120 / 80 ", 120.0, 80.0), ("120,80", 120.0, 80.0), ("120-80", 120.0, 80.0),
    ("120 80", 120.0, 80.0), ("120//80/70", 120.0, 80.0), ("120", 120.0, None), ("120/x", None, None), ("x/80", None, None), ("49/80", None, 80.0),
    ("50/30", 50.0, 30.0), ("300/200", 300.0, 200.0), ("301/201", None, None), ("1_20/8_0", 120.0, 80.0), ("120d/80", None, None), ("120f", None, None),
    ("inf/80", None, 80.0), ("nan/80", None, 80.0), ("1e2/80", 100.0, 80.0), ("0x1p3/80", None, None), ("+120/80", 120.0, 80.0), ("///", None, None),
]
YES_NO = [(None, 0.0), ("", 0.0), (" ya ", 1.0), ("Y", 1.0), ("true", 1.0), ("YES", 1.0), ("1", 1.0), ("*", 1.0), ("v", 1.0), ("Baru", 1.0), ("lama", 1.0),
          ("T", 0.0), ("tidak", 0.0), ("No", 0.0), ("FALSE", 0.0), ("0", 0.0), ("0.0", 0.0), ("3", 1.0), ("-2", 1.0), ("abc", 0.0), ("nan", 1.0), ("inf", 1.0),
          ("1_0", 1.0), ("0d", 0.0), ("3f", 0.0), ("1e2", 1.0)]


def test_tables_of_rules(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(BLOOD_PRESSURE)], "i int, x string")
    got = df.select("i", measures.split_blood_pressure("x").alias("bp")).orderBy("i").collect()
    assert [(r[0], g.bp.sistolik, g.bp.diastolik) for r, g in zip(BLOOD_PRESSURE, got)] == BLOOD_PRESSURE
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(YES_NO)], "i int, x string")
    assert [(r[0], g.y) for r, g in zip(YES_NO, df.select("i", encode.yes_no("x").alias("y")).orderBy("i").collect())] == YES_NO


@settings(max_examples=150, deadline=None)
@example(["1_20/80", "120d/80", "120f", "inf/80", "nan/80", "1e2/80", "120/8_0", "0x1p3/80", "+120/80",
          " ya ", "lama", "*", "3", "0.0", "abc", "nan", "inf", "1_0", "0d"])
@given(st.lists(st.one_of(st.none(), TEXTS), min_size=1, max_size=40))
def test_text_functions_match_rules(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    out = df.select(text.clean_text("x").alias("c"), text.numeric_text("x").alias("n"),
                    text.normalise_village("x").alias("v"),
                    measures.split_blood_pressure("x").alias("bp"), encode.yes_no("x").alias("yn"),
                    measures.split_blood_pressure(F.regexp_replace("x", "[, -]", "/")).alias("swapped"),
                    encode.yes_no(F.concat(F.lit("  "), F.lower("x"), F.lit("\t"))).alias("padded")).collect()
    for v, r in zip(values, out):
        assert r.c == py_clean_text(v), (v, r.c)
        exp = py_numeric(v)
        assert (r.n is None and exp is None) or (r.n is not None and exp is not None and math.isclose(r.n, exp)), (v, r.n)
        assert r.v == py_village(v), (v, r.v)
        # whatever the text: values lie in their bounds, and separators are interchangeable
        assert r.bp.sistolik is None or 50 <= r.bp.sistolik <= 300, (v, r.bp)
        assert r.bp.diastolik is None or 30 <= r.bp.diastolik <= 200, (v, r.bp)
        assert r.bp == r.swapped, (v, r.bp, r.swapped)
        assert r.yn in (0.0, 1.0) and r.yn == r.padded, (v, r.yn)
