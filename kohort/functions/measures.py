"""Clinical measure expressions: dates, age, BMI, blood pressure, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kohort import config as C
from kohort.functions.text import _col, strip



def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def zero_as_null(c) -> Column:
    """0 means 'not measured'."""
    x = _col(c)
    return F.when(x == 0, _null("double")).otherwise(x)


def parse_date(c, formats: tuple = C.DATE_FORMATS) -> Column:
    """Date text -> date by the first format that fits; anything else -> NULL.
    "iso" is Spark's own ISO cast, the others are datetime patterns."""
    x = _col(c).cast("string")
    return F.coalesce(*[x.try_cast("date") if f == "iso" else F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats])


def age(birth_date, as_of_year: int, lo: int = C.AGE_RANGE[0], hi: int = C.AGE_RANGE[1]) -> Column:
    """as_of_year - year(birth); outside [lo, hi] -> NULL."""
    a = (F.lit(as_of_year) - F.year(_col(birth_date))).cast("double")
    return F.when(a.between(lo, hi), a).otherwise(_null("double"))


def bmi(weight_kg, height_cm, lo: float = C.BMI_RANGE[0], hi: float = C.BMI_RANGE[1]) -> Column:
    """Kg / (cm/100)^2 rounded to 2 places; height 0 or outside [lo, hi] -> NULL."""
    h = _col(height_cm) / F.lit(100.0)
    v = F.round(F.try_divide(_col(weight_kg), h * h), 2)
    return F.when(v.between(lo, hi), v).otherwise(_null("double"))


def in_range(c, lo, hi) -> Column:
    """Keep values inside the inclusive range, NULL otherwise."""
    x = _col(c)
    return F.when(x.between(lo, hi), x)


def out_of_range(c, lo, hi) -> Column:
    x = _col(c)
    return (x < lo) | (x > hi)


def binary_only(c) -> Column:
    """Values outside {0, 1} become NULL."""
    x = _col(c)
    return F.when(x.isin(0, 1), x)


def python_float(c) -> Column:
    """Text -> double with Python ``float()`` rules (surrounding whitespace allowed,
    ``_`` between digits allowed, ``inf``/``nan`` accepted), else NULL. Spark's cast
    also takes Java's ``d``/``f`` suffixes and hex floats, which are rejected here."""
    t = F.regexp_replace(strip(_col(c).cast("string")), r"(?<=[0-9])_(?=[0-9])", "")
    java_only = (t.rlike(r"[dDfF]$") & ~F.lower(t).rlike(r"inf$")) | t.rlike(r"^[+-]?0[xX]")
    return F.when(java_only, _null("double")).otherwise(t.try_cast("double"))


def _py_float(c) -> Column:
    """Text with ',' as decimal point -> ``python_float``."""
    return python_float(F.replace(_col(c).cast("string"), F.lit(","), F.lit(".")))


def bmi_from_text(val, weight, height, lo: float = C.BMI_RANGE[0], hi: float = C.BMI_RANGE[1]) -> Column:
    """BMI from weight/height (height > 3 is cm), else the first number of the text."""
    w = _py_float(weight)
    h = _py_float(height)
    h_m = F.when(h > 3, h / F.lit(100.0)).otherwise(h)
    calc = F.try_divide(w, h_m * h_m)
    calc_ok = F.when(calc.between(lo, hi), F.round(calc, 2))
    first = F.regexp_extract(strip(_col(val).cast("string")), r"([0-9]+(?:[.,][0-9]+)?)", 1)
    num = F.replace(first, F.lit(","), F.lit(".")).try_cast("double")
    text_ok = F.when(num.between(lo, hi), F.round(num, 2))
    return F.coalesce(calc_ok, text_ok, _null("double"))


def split_blood_pressure(c) -> Column:
    """P15: 'sys/dia' (also ',', '-', ' ' separated) -> struct(sistolik, diastolik)."""
    s = F.translate(strip(_col(c).cast("string")), ",- ", "///")
    parts = F.filter(F.split(s, "/"), lambda p: strip(p) != "")
    p0 = F.try_element_at(parts, F.lit(1))
    p1 = F.try_element_at(parts, F.lit(2))
    sys_v = python_float(p0)
    dia_v = python_float(p1)
    ok = sys_v.isNotNull() & (p1.isNull() | dia_v.isNotNull())
    lo_s, hi_s = C.BP_SYS_RANGE
    lo_d, hi_d = C.BP_DIA_RANGE
    sys_out = F.when(ok & sys_v.between(lo_s, hi_s), sys_v).otherwise(_null("double"))
    dia_out = F.when(ok & dia_v.between(lo_d, hi_d), dia_v).otherwise(_null("double"))
    return F.struct(sys_out.alias("sistolik"), dia_out.alias("diastolik"))
