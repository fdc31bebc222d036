"""Dates, amounts and labelled fields read from text, as column expressions.

Times are epoch seconds; 0 means unknown, as everywhere in this library. Local times are UTC+8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import CITIES, PROVINCES
from .text import first_of, text

_DATE = "(20\\d{2})[年./-](\\d{1,2})[月./-](\\d{1,2})日?(?:(?U:[ T\\s]+)(\\d{1,2})[:：](\\d{2})(?:[:：](\\d{2}))?)?"
_ZONE = 8 * 3600


def date_ts(c: Column | str) -> Column:
    """Epoch seconds of the first date in a text, UTC+8; 0 if there is none or it does not exist."""
    part = lambda n, least: F.coalesce(F.nullif(F.regexp_extract(text(c), _DATE, n), F.lit("")), F.lit(least))
    stamp = F.format_string("%s-%s-%s %s:%s:%s", part(1, "x"), *[F.lpad(part(n, "0"), 2, "0") for n in (2, 3, 4, 5, 6)])
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.concat(stamp, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))) - _ZONE, F.lit(0)).cast("double")


def expired(deadline: Column | str, now: float) -> Column:
    """A deadline without a time lasts through its day; no deadline never expires."""
    ts = date_ts(deadline)
    through = F.when(text(deadline).rlike("\\d{1,2}[:：]\\d{2}"), 0).otherwise(86400)
    return (ts > 0) & (ts + through <= now)


def amount(c: Column | str) -> Column:
    """First amount of money in a text, in yuan; null if there is none."""
    pattern = "([0-9]+(?:[,.][0-9]+)*)(?U:\\s*)(亿元|万元|万|元)"
    number = F.replace(F.regexp_extract(text(c), pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.regexp_extract(text(c), pattern, 2)
    return number * F.when(unit == "亿元", 1e8).when(unit.isin("万元", "万"), 1e4).when(unit == "元", 1.0)


def budget(c: Column | str) -> Column:
    return F.replace(F.regexp_extract(text(c), "(?i)(?:预算(?:金额)?|最高限价|项目金额)(?U:[：:\\s]*)([0-9,.]+(?U:\\s*)(?:亿元|万元|万|元))", 1), F.lit(" "), F.lit(""))


def deadline(c: Column | str) -> Column:
    return F.regexp_extract(text(c), "(?:投标截止(?:时间)?|报名截止(?:时间)?|截止时间)(?U:[：:\\s]*)(20\\d{2}[年./-]\\d{1,2}[月./-]\\d{1,2}日?(?:(?U:\\s+)\\d{1,2}[:：]\\d{2}(?:[:：]\\d{2})?)?)", 1)


def owner(c: Column | str) -> Column:
    return F.trim(F.regexp_extract(text(c), "(?:采购人|招标人|建设单位)(?U:[：:\\s]*)([^，。；;\\n]{2,60})", 1))


def province(c: Column | str) -> Column:
    return first_of(text(c), PROVINCES)


def city(c: Column | str) -> Column:
    return first_of(text(c), CITIES)


def last_year(title: Column | str) -> Column:
    """The largest year 20xx in a title that no digit touches; null if none."""
    return F.array_max(F.transform(F.regexp_extract_all(text(title), F.lit("(?<!\\d)(20\\d{2})(?!\\d)"), F.lit(1)), lambda y: y.cast("int")))
