"""Numbers, ids, URLs and times as Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SAFE = 2**53 - 1


def parse_compact_number(c: Column, normalised: bool = True) -> Column:
    """``1.4k``, ``2M``, ``1,234`` to a number; words, too large numbers and the like to null. ``c`` is clean text."""
    text = F.replace(F.lower(F.trim(c)), F.lit(","), F.lit(""))
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)[km]?$", 1).try_cast("double")
    scaled = number * F.when(text.endswith("k"), 1e3).when(text.endswith("m"), 1e6).otherwise(1.0)
    return F.when(scaled <= MAX_SAFE, F.floor(scaled).cast("long"))


def item_id_of(url: Column) -> Column:
    return F.regexp_extract(url, r"/movies/([0-9]+)", 1).try_cast("long")


def entity_id_of(url: Column) -> Column:
    return F.regexp_extract(url, r"/(?:authors|tags|origins|characters)/([0-9]+)", 1).try_cast("long")


def parse_csv_ids(c: Column, limit: int) -> Column:
    """Ids of a comma-separated list: digits only, first occurrences, at most ``limit``."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    ids = F.transform(F.filter(parts, lambda x: x.rlike("^[0-9]+$")), lambda x: x.try_cast("decimal(38,0)"))
    return F.slice(F.array_distinct(F.transform(F.filter(ids, lambda x: x <= MAX_SAFE), lambda x: x.cast("long"))), 1, limit)


def parse_bounded_int(c: Column, low: int = 0, high: int = MAX_SAFE) -> Column:
    text = F.replace(F.trim(c), F.lit(","), F.lit(""))
    number = F.substring(text, 1, 20).try_cast("decimal(20,0)")
    return F.when(text.rlike("^[0-9]+$"), F.least(F.greatest(number, F.lit(low).cast("decimal(20,0)")), F.lit(high).cast("decimal(20,0)")).cast("long"))


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.lit(size))).cast("long")


def safe_url(c: Column, hosts: Sequence[str]) -> Column:
    """The URL if it is https, without user info, on one of ``hosts`` or a subdomain; else null.

    The URI parser of the JVM rejects blanks and raw non-ASCII characters: on the safe side.
    """
    url = F.trim(c)
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.+$", "")
    fine = (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    known = F.lit(False)
    for h in hosts:
        known = known | (host == h.lower()) | host.endswith("." + h.lower())
    checked = F.when(F.coalesce(fine & known, F.lit(False)), F.regexp_replace(url, "^(?i:https):", "https:"))
    simple = [re.escape(h) for h in hosts if re.fullmatch(r"(?:[a-z][a-z0-9]*\.)+[a-z]+", h)]
    if not simple:
        return checked
    # most links are on one of the hosts and of letters and digits that mean nothing else in a URL: they are fine without three runs of the parser
    plain = url.rlike(rf"^https://(?:{'|'.join(simple)})/[A-Za-z0-9/_.~-]*(?:\?[A-Za-z0-9/_.~=&-]*)?\z")
    return F.when(plain, url).otherwise(checked)


def absolute_url(c: Column, base: str) -> Column:
    """A link as an absolute URL; null and empty links give null."""
    origin = base.split("/", 3)
    root = "/".join(origin[:3])
    link = F.trim(c)
    return (
        F.when(c.isNull() | (link == ""), None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit(root.split(":")[0] + ":"), link))
        .when(link.startswith("/"), F.concat(F.lit(root), link))
        .otherwise(F.concat(F.lit(base.rstrip("/") + "/"), link))
    )


def format_count(c: Column) -> Column:
    return F.format_number(F.coalesce(c, F.lit(0)).cast("long"), 0)


def _one_decimal(n: Column, size: int) -> Column:
    """n / size to one decimal as text. A tie is decided by the binary value of the quotient, else half to even."""
    whole, rest = F.floor(n * 10 / F.lit(size)).cast("long"), F.pmod(n * 10, F.lit(size)) * 2
    quotient = n / F.lit(float(size))
    scaled = ((quotient - F.floor(quotient)) * float(1 << 52)).cast("long").cast("decimal(38,0)") * 20
    tie = (whole % 10 * 2 + 1).cast("decimal(38,0)") * F.lit(1 << 52)
    up = (rest > size) | ((rest == size) & ((scaled > tie) | ((scaled == tie) & (whole % 2 == 1))))
    tenths = whole + up.cast("int")
    return F.regexp_replace(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")), r"\.0$", "")


def format_compact(c: Column, lang: str = "en") -> Column:
    """1 234 567 as ``1.2M`` (or in units of ten thousand for Chinese and Japanese)."""
    n = F.coalesce(c, F.lit(0)).cast("long")
    east = {"zh-Hans": "亿", "ja": "億"}.get(lang)
    units = ((10**8, east), (10**4, "万")) if east else ((10**9, "B"), (10**6, "M"), (10**3, "K"))
    out = F.format_number(n, 0) if east else n.cast("string")
    for size, unit in reversed(units):
        out = F.when(n >= size, F.concat(_one_decimal(n, size), F.lit(unit))).otherwise(out)
    return out


def parse_published(c: Column) -> Column:
    at = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    return at.cast("timestamp_ntz")


def iso_datetime(at: Column, offset: str = "+09:00") -> Column:
    return F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset)), F.lit(""))


def format_timestamp(at: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit(""))


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def relative_time(at: Column, now: Column) -> Column:
    """A struct (unit, count): just_now, minutes, hours, days, or date for the future and for 30 days and more."""
    seconds = (micros(now) - micros(at)) / 1e6
    minutes = F.floor(seconds / 60)
    hours, days = F.floor(minutes / 60), F.floor(F.floor(minutes / 60) / 24)
    pick = lambda unit, n: F.struct(F.lit(unit).alias("unit"), n.cast("long").alias("count"))
    return (
        F.when(at.isNull(), None)
        .when((seconds < 0) | (days >= 30), pick("date", F.lit(None)))
        .when(minutes < 1, pick("just_now", F.lit(None)))
        .when(minutes < 60, pick("minutes", minutes))
        .when(hours < 24, pick("hours", hours))
        .otherwise(pick("days", days))
    )


def retry_delay_seconds(attempts: Column) -> Column:
    """Half an hour, doubled with each attempt, at most a week."""
    return F.least(F.lit(604800.0), 1800.0 * F.pow(F.lit(2.0), attempts - 1)).cast("long")
