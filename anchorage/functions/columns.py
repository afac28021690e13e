"""Column rules for cleaning and deriving fields; all built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acronyms kept in upper case in feature labels.
ACRONYMS = ("Pac", "Pbs", "Ips", "Eps", "Ltv", "Ibnr", "Rsf", "Shap", "Id", "Bin")

# Month names in calendar order, whole and short, English and Spanish.
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
    "ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic",
)

# Count bands and their order.
COUNT_BANDS = ("0", "1", "2 a 5", "6+")

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
NO_BREAK_SPACE = " "
DAYS_PER_MONTH = 30.4375


def number_or_null(text: Column) -> Column:
    """Double when the text is a plain number; Spark's cast alone would accept '1d'."""
    clean = F.trim(text)
    return F.when(clean.rlike(NUMBER), clean.try_cast("double"))


def century(year: Column) -> Column:
    return F.when(year.cast("int") >= 69, "19").otherwise("20")


def month_number(name: Column) -> Column:
    """Number of an English or Spanish month name in lower case, whole or of three letters; else null."""
    place = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), name)
    return F.when(place > 0, (place - 1) % 12 + 1).cast("int")


def named_months(text: Column) -> tuple[Column, Column]:
    """The parts of a date with a month name, joined by ``-`` with the name as a number, and whether there is one."""
    joined = F.regexp_replace(F.lower(F.trim(text)), r"\s+de\s+|[/., -]+", "-")
    part = lambda i: F.regexp_extract(joined, r"^(\d+)-([a-z]+)-(\d+)$", i)
    return F.concat_ws("-", part(1), month_number(part(2)).cast("string"), part(3)), month_number(part(2)).isNotNull()


def parse_date_any(text: Column) -> Column:
    """Day-month-year first, then year-month-day, with / - . or space between the parts.

    Years of two digits are 1969 to 2068. The month may be a number or an English or
    Spanish name, with ``de`` around it or not.
    """
    named, has_name = named_months(text)
    joined = F.when(has_name, named).otherwise(F.regexp_replace(F.trim(text), "[/. ]", "-"))
    day_first = F.when(joined.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), joined)
    year_first = F.when(joined.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), joined)
    digits = F.when(joined.rlike(r"^\d{8}$"), joined)
    short = F.when(joined.rlike(r"^\d{1,2}-\d{1,2}-\d{2}$"), joined)
    last, first = F.substring(short, -2, 2), F.substring_index(short, "-", 1)
    day_first_short = F.concat(F.substring_index(short, "-", 2), F.lit("-"), century(last), last)
    year_first_short = F.when(F.length(first) == 2, F.concat(century(first), short))
    return F.coalesce(
        F.try_to_date(day_first, "d-M-y"),
        F.try_to_date(digits, "ddMMyyyy"),
        F.try_to_date(year_first, "y-M-d"),
        F.try_to_date(digits, "yyyyMMdd"),
        F.try_to_date(day_first_short, "d-M-y"),
        F.try_to_date(year_first_short, "y-M-d"),
    )


def safe_num(text: Column) -> Column:
    return number_or_null(F.replace(text.cast("string"), F.lit(","), F.lit(".")))


def numify_simple(text: Column) -> Column:
    packed = F.regexp_replace(text.cast("string"), f"[{NO_BREAK_SPACE} ]", "")
    return number_or_null(F.replace(packed, F.lit(","), F.lit(".")))


def parse_money(text: Column) -> Column:
    return number_or_null(F.regexp_replace(text.cast("string"), "[^0-9.]", ""))


def _ungrouped(text: Column) -> Column:
    return number_or_null(F.regexp_replace(text.cast("string"), f"[{NO_BREAK_SPACE} ,]", ""))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def num_or(text: Column, default: float) -> Column:
    value = _ungrouped(text)
    return F.when(is_finite(value), value).otherwise(F.lit(float(default)))


def int_or(text: Column, default: Column | int) -> Column:
    """Truncated integer; missing, unreadable or non-positive values take the default."""
    value = number_or_null(F.replace(text.cast("string"), F.lit(","), F.lit(""))).try_cast("int")
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(value > 0, value).otherwise(fallback.cast("int"))


def upper_trim(text: Column) -> Column:
    return F.upper(F.trim(text.cast("string")))


def sex_bin(text: Column) -> Column:
    code = upper_trim(text)
    return F.when(code == "M", 1).when(code == "F", 0)


# The accepted spellings of yes and no in each input form.
YES_NO = {
    "profile": (("SI", "SÍ", "YES", "Y", "1"), ("NO", "N", "0")),
    "table": (("SI", "SÍ", "YES", "1", "TRUE"), ("NO", "0", "FALSE")),
}


def yes_no_bin(text: Column, mode: str = "profile") -> Column:
    yes, no = YES_NO[mode]
    code = upper_trim(text)
    return F.when(code.isin(*yes), 1).when(code.isin(*no), 0)


def clean_cluster(text: Column) -> Column:
    """Noise marks -1 and 999 become 999; otherwise the first signed integer in the text."""
    code = F.trim(text.cast("string"))
    digits = F.regexp_extract(code, r"(-?\d+)", 1)
    return F.when(code.isin("-1", "999"), 999).otherwise(digits.try_cast("int"))


def norm_group(text: Column) -> Column:
    code = upper_trim(text)
    return F.when(code.isin("ACTIVO", "ACTIVOS"), "ACTIVO").when(
        code.isin("CANCELADO", "CANCELADOS"), "CANCELADO"
    )


def pretty_feature_name(text: Column) -> Column:
    label = F.initcap(F.lower(F.trim(F.regexp_replace(text.cast("string"), r"[_\s]+", " "))))
    for word in ACRONYMS:
        label = F.regexp_replace(label, rf"\b{word}\b", word.upper())
    return F.regexp_replace(label, r"\bCd\b", "Cod.")


def bucket_0_1_2_5_6p(count: Column) -> Column:
    n = F.coalesce(count.cast("double"), F.lit(0.0))
    return (
        F.when(n <= 0, COUNT_BANDS[0])
        .when(n == 1, COUNT_BANDS[1])
        .when(n.between(2, 5), COUNT_BANDS[2])
        .when(n >= 6, COUNT_BANDS[3])
    )


def band_order(band: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, COUNT_BANDS)), band).cast("int")


def clamp01(value: Column) -> Column:
    """Limit to [0, 1]; a missing value stays missing (greatest/least alone would hide it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def date_plus_months(start: Column, months: Column) -> Column:
    return F.date_add(start, F.bround(months * F.lit(DAYS_PER_MONTH)).cast("int"))


def _whole_months(start: Column, end: Column) -> Column:
    gap = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return gap - (F.day(end) < F.day(start)).cast("int")


def months_elapsed(start: Column, end: Column) -> Column:
    """Calendar months with day adjustment, never negative."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(_whole_months(start, end), F.lit(0)))


def months_frac(start: Column, end: Column) -> Column:
    """Whole months plus the elapsed fraction of the month that follows, never negative."""
    whole = _whole_months(start, end)
    left = F.datediff(end, F.add_months(start, whole))
    length = F.datediff(F.add_months(start, whole + 1), F.add_months(start, whole))
    value = whole + left / length
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def cut(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed fixed bins: (edges[i], edges[i+1]] gets labels[i]; outside is null."""
    out = F.when(value <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels, strict=True):
        out = out.when(value <= upper, label)
    return out


def tie_order(key: Column) -> Column:
    """First 32 md5 bits of a key: an even tie order that other SQL engines can repeat."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(0))


def hash_percent(key: Column) -> Column:
    """Repeatable 0..99 draw per key."""
    return (tie_order(key) % 100).cast("int")
