"""Column functions: codes, numbers, dates, text keys and composite scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Exchange of a six-digit code by its first digit.
EXCHANGES = {"6": "SH", "9": "SH", "0": "SZ", "3": "SZ", "2": "SZ", "8": "BJ", "4": "BJ"}


def code6(raw: Column) -> Column:
    """The six digits of any spelling (sh600000, 600000.SH, 600000), zero-padded; '' without digits."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^0-9]", "")
    return F.when(F.length(digits) == 0, "").when(F.length(digits) > 6, F.right(digits, F.lit(6))).otherwise(F.lpad(digits, 6, "0"))


def exchange(code: Column) -> Column:
    out = None
    for head, name in EXCHANGES.items():
        hit = F.substring(code, 1, 1) == head
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def prefixed(raw: Column) -> Column:
    return F.concat(exchange(code6(raw)), code6(raw))


def code_valid(code: Column) -> Column:
    return F.coalesce(code.rlike("^[0-9]{6}$"), F.lit(False))


def pretty(name: Column, code: Column) -> Column:
    return F.when(name.isNotNull() & (name != ""), F.concat(name, F.lit("("), code, F.lit(")"))).otherwise(code)


def parse_num(raw: Column) -> Column:
    """Thousands separators and percent signs go; '', '-', '--', 'nan', junk and infinities are null."""
    text = F.regexp_replace(F.trim(raw), r"[,，%]", "")
    value = text.try_cast("double")
    return F.when(~F.lower(text).isin("", "-", "--", "nan", "none", "null") & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def parse_date(raw: Column, year: Column) -> Column:
    """Year-month-day anywhere in the text (with or without dashes), or month-day in the given year."""
    whole = F.regexp_extract(raw, r"(\d{4}-\d{2}-\d{2})", 1)
    compact = F.regexp_extract(raw, r"^(\d{8})(?:\D|$)", 1)
    short = F.regexp_extract(raw, r"(\d{2}-\d{2})", 1)
    return F.when(whole != "", F.try_to_timestamp(whole, F.lit("yyyy-MM-dd"))).when(compact != "", F.try_to_timestamp(compact, F.lit("yyyyMMdd"))).when(short != "", F.try_to_timestamp(F.concat(year.cast("string"), F.lit("-"), short), F.lit("yyyy-MM-dd"))).cast("date")


def epoch_to_local(raw: Column, zone: str = "Asia/Shanghai") -> Column:
    """Epoch seconds or milliseconds to local text; nothing or not positive: ''."""
    ms = F.when(raw > 10**11, raw).otherwise(raw * 1000)
    text = F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.coalesce(raw, F.lit(0)) > 0, text).otherwise("")


def prev_weekday(day: Column) -> Column:
    back = F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1)
    return F.date_sub(day, back)


def yi(raw: Column) -> Column:
    """Yuan to 1e8 yuan, two digits; junk: 0."""
    return F.round(F.coalesce(raw.try_cast("double"), F.lit(0.0)) / 1e8, 2)


def title_key(title: Column, n: int = 12) -> Column:
    return F.left(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^0-9A-Za-z\x{4e00}-\x{9fa5}]", ""), F.lit(n))


def absolute_year(current: Column, published: Column) -> Column:
    """The publish year unless it is missing or after the current one."""
    return F.when(published.isNotNull() & (current.isNull() | (published <= current)), published).otherwise(current)


def clean_html(raw: Column) -> Column:
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)<[^>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def half_up(x: Column, digits: int) -> Column:
    """x to some digits, halves away from zero. A half is one of x * 10^digits as a double,
    so 28.849999999999998, which stands for 28.85, goes to 28.9."""
    return F.round(x * 10.0**digits) / 10.0**digits


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def score_a(revision: Column, sue: Column, gap: Column) -> Column:
    """struct(score, n, rankable): three parts weighted .40, .35, .25, over those that are known."""
    parts = ((revision, clamp01(revision / 0.20), 0.40), (sue, clamp01((sue + 2.0) / 4.0), 0.35), (gap, clamp01((gap + 0.20) / 0.40), 0.25))
    weight = sum((F.when(raw.isNotNull(), w).otherwise(0.0) for raw, _, w in parts), F.lit(0.0))
    total = sum((F.when(raw.isNotNull(), norm * w).otherwise(0.0) for raw, norm, w in parts), F.lit(0.0))
    n = sum((F.when(raw.isNotNull(), 1).otherwise(0) for raw, _, _ in parts), F.lit(0))
    return F.struct(F.when(weight > 0, half_up(total / weight * 100, 1)).otherwise(0.0).alias("score"), n.alias("n"), (n >= 2).alias("rankable"))


def score_b(level: Column, metric: Column, metrics: Column, tightness: Column, traps: Column, binding_not: Column, scheme: Column, connector: Column) -> Column:
    """Stage, metrics, tightness and traps weighted .6, .2, .1, .1; an unknown tightness is left out."""
    penalty = F.least(F.lit(30.0), traps * 3.0) + F.least(F.lit(20.0), binding_not * 5.0) + F.when(scheme == "subsidiary", 10.0).otherwise(0.0) + F.when(connector == "or", 5.0).otherwise(0.0) + F.when(metric.isin("other", "output", "line"), 10.0).otherwise(0.0)
    tight = F.when(tightness == "above", 1.0).when(tightness == "near", 0.7).when(tightness == "below", 0.2)
    profit = F.when(metric.contains("profit") | F.array_join(metrics, " ").contains("profit"), 1.0).otherwise(0.0)
    total = 0.6 * clamp01(level / 5.0) + 0.2 * profit + 0.1 * clamp01(1 - penalty / 100) + F.when(tight.isNotNull(), 0.1 * tight).otherwise(0.0)
    weight = F.when(tightness.isin("above", "near", "below"), 1.0).otherwise(0.9)
    return F.round(total / weight * 100, 1)
