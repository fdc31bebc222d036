"""Publication dates of news, as column expressions.

A time is epoch seconds, 0 if unknown; a label is the day in UTC+8, empty if unknown. Null text counts as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import text

ZONE = 8 * 3600
DATED = "struct<ts:double,label:string>"
# The forms in which pages and feeds give dates.
FULL = "(?<!\\d)(20\\d{2})[-/年](\\d{1,2})[-/月](\\d{1,2})(?:日)?(?:[T ](\\d{1,2}):(\\d{2})(?::(\\d{2}))?(Z|[+-]\\d{2}:?\\d{2})?)?"
REVERSED = "(?<!\\d)(\\d{2})-(\\d{2})\\s+(20\\d{2})(?!\\d)"
LOOSE = "(20\\d{2})\\s*[-/.年]\\s*(\\d{1,2})\\s*[-/.月]\\s*(\\d{1,2})"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
EXPIRY_KEYS = ("expiry", "expire", "expires_at", "expiry_time", "expire_time", "expired_at", "token_expire_time", "token_expires_at")


def day(ts: Column) -> Column:
    """yyyy-MM-dd in UTC+8; years of five digits have no sign."""
    return F.ltrim(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((ts + ZONE) / 86400).cast("int")).cast("string"), F.lit("+"))


def _epoch(year: Column, month: Column, date: Column, hour: Column | None = None, minute: Column | None = None, second: Column | None = None) -> Column:
    """Seconds as if in UTC; null if the moment does not exist."""
    two = lambda c: F.lpad(F.coalesce(F.nullif(c, F.lit("")), F.lit("0")), 2, "0") if c is not None else F.lit("00")
    stamp = F.format_string("%s-%s-%s %s:%s:%s+00:00", year, two(month), two(date), two(hour), two(minute), two(second))
    return F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ssXXX"))).cast("double")


def news_date(c: Column | str) -> Column:
    """struct<ts, label> of the first full date in a text, else of the first month-day-year date.

    A time without an offset is UTC+8. A first date that does not exist makes the whole unknown.
    """
    t = text(c)
    p = lambda n: F.regexp_extract(t, FULL, n)
    back = lambda n: F.regexp_extract(t, REVERSED, n)
    offset = F.replace(p(7), F.lit(":"), F.lit(""))
    east = F.substring(offset, 2, 2).try_cast("int") * 3600 + F.substring(offset, 4, 2).try_cast("int") * 60
    zone = F.when(offset == "", ZONE).when(offset == "Z", 0).when(F.startswith(offset, F.lit("-")), -east).otherwise(east)
    full = F.when(F.abs(zone) < 86400, _epoch(p(1), p(2), p(3), p(4), p(5), p(6)) - zone)
    ts = F.when(p(1) != "", full).when(back(3) != "", _epoch(back(3), back(1), back(2)) - ZONE)
    return F.struct(F.coalesce(ts, F.lit(0.0)).alias("ts"), F.coalesce(day(ts), F.lit("")).alias("label"))


def unique_date(values: Column) -> Column:
    """struct<ts, label> of an array of texts: the first date if all that are dates fall on one day, else unknown."""
    known = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), news_date), lambda d: d["ts"] != 0)
    one = F.size(F.array_distinct(F.transform(known, lambda d: d["label"]))) == 1
    none = F.struct(F.lit(0.0).alias("ts"), F.lit("").alias("label"))
    return F.when(one, F.get(known, 0)).otherwise(none)


def article_date(c: Column | str, ts: Column | float = 0.0) -> Column:
    """yyyy-MM-dd of a source's date text, in any of the forms that sources use; else of the time; else empty."""
    t = F.trim(text(c))
    p = lambda n: F.regexp_extract(t, LOOSE, n)
    iso = lambda n: F.regexp_extract(t, "^(\\d{4})-(\\d{2})-(\\d{2})(?:[T ].*)?$", n)
    mail = lambda n: F.regexp_extract(t, "(?i)(?:^|[ ,])(\\d{1,2}) +(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* +(\\d{4})", n)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(mail(2))).cast("string")
    label = lambda seconds: day(seconds - ZONE)
    seconds = F.lit(ts) if isinstance(ts, float) else F.coalesce(ts, F.lit(0.0))
    return F.coalesce(
        F.when(p(1) != "", label(_epoch(p(1), p(2), p(3)))), F.when(iso(1) != "", label(_epoch(iso(1), iso(2), iso(3)))),
        F.when(mail(3) != "", label(_epoch(mail(3), month, mail(1)))), F.when(seconds != 0, day(seconds)), F.lit(""),
    )


def expiry_ts(c: Column | str) -> Column:
    """Epoch seconds of a credential's end: seconds, milliseconds above 10**10, or a date and time; null if unreadable."""
    t = F.trim(text(c))
    number = t.try_cast("double")
    p = lambda n: F.regexp_extract(t, "^(\\d{4})[-/](\\d{2})[-/](\\d{2})(?:[T ](\\d{2}):(\\d{2})(?::(\\d{2})(?:\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?)?$", n)
    offset = F.replace(p(7), F.lit(":"), F.lit(""))
    east = F.substring(offset, 2, 2).try_cast("int") * 3600 + F.substring(offset, 4, 2).try_cast("int") * 60
    zone = F.when(offset == "", ZONE).when(offset == "Z", 0).when(F.startswith(offset, F.lit("-")), -east).otherwise(east)
    return F.when(t.rlike("^[0-9]+(\\.[0-9]+)?$"), F.when(number > 1e10, number / 1000).otherwise(number)).when(p(1) != "", _epoch(p(1), p(2), p(3), p(4), p(5), p(6)) - zone)


@F.pandas_udf(StringType())
def expiry_value(payload: pd.Series) -> pd.Series:
    """The first end-of-validity field anywhere in a JSON document: an object's own keys before what lies below them."""
    import json

    def find(node):  # noqa: ANN001, ANN202
        if isinstance(node, dict):
            for k, v in node.items():
                if str(k).lower() in EXPIRY_KEYS:
                    return v
        below = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        return next((v for v in map(find, below) if v is not None), None)

    def read(x: str | None) -> str | None:
        try:
            found = find(json.loads(x or ""))
        except (ValueError, RecursionError):
            return None
        return None if found is None else str(found)

    return payload.map(read)


def dated_query(query: Column, today: str, days: Column | int) -> Column:
    """A search with the days it should cover. The words around the days."""
    since = F.date_sub(F.lit(today).cast("date"), days).cast("string")
    return F.concat(query, F.lit(" 发布时间 "), since, F.lit(f" 至 {today} 优先原始公告，排除历史案例和纯行业资讯"))


def body_publication(c: Column | str) -> Column:
    """The labelled date of publication in a body; empty without one that exists."""
    from .facts import date_ts

    found = F.regexp_extract(text(c), "(?:发布时间|发布日期|发布于|发表于)(?U:\\s*)[：:]?(?U:\\s*)(20\\d{2}[年./-]\\d{1,2}[月./-]\\d{1,2}日?(?:(?U:[ T\\s]+)\\d{1,2}[:：]\\d{2}(?:[:：]\\d{2})?)?)", 1)
    return F.when(date_ts(found) != 0, found).otherwise("")
