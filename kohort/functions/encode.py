"""Categorical encoders (P07-P13) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kohort import config as C
from kohort.functions.text import _col, strip



def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def sex(c) -> Column:
    """Exact 'Laki-laki' -> 1; everything else (NULL included) -> 0."""
    t = strip(c)
    male = [k for k, v in C.SEX_TEXT.items() if v == 1]
    return F.when(t.isin(*male), F.lit(1)).otherwise(F.lit(0))


def hypertension(c) -> Column:
    """Exact 'Ya' -> 1, 'Tidak' -> 0, else NULL."""
    t = strip(c)
    out = None
    for text, code in C.HYPERTENSION_TEXT.items():
        out = F.when(t == text, F.lit(code)) if out is None else out.when(t == text, F.lit(code))
    return out.otherwise(_null("int"))


def cognitive(c) -> Column:
    """P09: 'ada gangguan' without 'tidak' -> 1; 'tidak ada gangguan' -> 0; else NULL."""
    s = F.lower(strip(c))
    return (F.when(s.contains("ada gangguan") & ~s.contains("tidak"), F.lit(1))
            .when(s.contains("tidak ada gangguan"), F.lit(0))
            .otherwise(_null("int")))


def malnutrition(c) -> Column:
    """P10: 'berisiko' or ('malnutrisi' and not 'normal') -> 1; 'normal' -> 0; else NULL."""
    s = F.lower(strip(c))
    return (F.when(s.contains("berisiko") | (s.contains("malnutrisi") & ~s.contains("normal")), F.lit(1))
            .when(s.contains("normal"), F.lit(0))
            .otherwise(_null("int")))


def depression(c) -> Column:
    """P11: ''/'nan'/'none' -> NULL; 'ada' without 'tidak' -> 1; 'tidak' -> 0; other text -> 1."""
    s = F.lower(strip(c))
    return (F.when(s.isNull() | s.isin("nan", "none", ""), _null("int"))
            .when(s.contains("ada") & ~s.contains("tidak"), F.lit(1))
            .when(s.contains("tidak"), F.lit(0))
            .otherwise(F.lit(1)))


def sex_code(c) -> Column:
    """L/LAKI-LAKI/LAKI/1 -> 1.0; P/PEREMPUAN/PR/0 -> 0.0; else NULL."""
    s = F.upper(strip(_col(c).cast("string")))
    return (F.when(s.isin(*C.SEX_CODE_MALE), F.lit(1.0))
            .when(s.isin(*C.SEX_CODE_FEMALE), F.lit(0.0))
            .otherwise(_null("double")))


def yes_no(c, visit: bool = False) -> Column:
    """yes/no/visit markers to 1.0/0.0; NULL -> 0.0; numbers -> (x != 0); other -> 0.0."""
    x = _col(c).cast("string")
    s = F.upper(strip(x))
    out = F.when(x.isNull(), F.lit(0.0)).when(s.isin(*C.BOOL_VISIT), F.lit(1.0))
    if visit:
        return out.otherwise(F.lit(0.0))
    from kohort.functions.measures import python_float
    num = python_float(s)
    return (out.when(s.isin(*C.BOOL_TRUE), F.lit(1.0))
            .when(s.isin(*C.BOOL_FALSE), F.lit(0.0))
            .when(num.isNotNull(), F.when(num != 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(0.0)))
