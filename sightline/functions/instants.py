"""Texts of mixed timestamp forms to UTC instants, as JVM expressions that don't depend on the session's time zone."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_ZONE = r"(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?"

#: Forms with a time of day; each gives year|month|day|hour|minute|second|fraction|zone.
_STAMPS = [
    (rf"(?i)^(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}})(?:T| +)(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)? *{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8|$9"),
    (r"^\[?(\d{1,2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))? *([+-]\d{4})?\]?$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"(?i)^(?:[a-z]{{3,9}}, *)?(\d{{1,2}})[ -]([a-z]{{3,9}})[ -](\d{{4}}),? +(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.(\d+))?)? *{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:\.(\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.(\d+))?)? *{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
]
#: Forms without a time of day.
_DAYS = [
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", "$1|$3|$4|0|0|0||"),
    (r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})$", "$3|$1|$2|0|0|0||"),
    (r"^(\d{1,2})[ .-]+([A-Za-z]{3,9})[ .-]+(\d{4})$", "$3|$2|$1|0|0|0||"),
]
#: Day and month as numbers before the year: the locale tells which is first.
_NUMERIC_DAY = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$"
_COMPACT_DAY = r"^((?:19|20)\d{2})(0[1-9]|1[0-2])(\d{2})$"
_NUMBER = r"^\d{1,25}(?:\.\d+)?$"
#: Numbers below this in a day column are days of a spreadsheet, counted so that 25569 is 1970-01-01.
_SERIAL_LIMIT, _SERIAL_EPOCH = 200_000, 25_569


def _days(y: str, m: str, d: str) -> str:
    """Days since 1970 of a proleptic Gregorian date as integer arithmetic."""
    yy = f"({y} - IF({m} <= 2, 1, 0))"
    return (
        f"({yy} * 365 + {yy} div 4 - {yy} div 100 + {yy} div 400 + "
        f"(153 * (({m} + 9) % 12) + 2) div 5 + {d} - 1 - 719468)"
    )


def with_instant(
    df: DataFrame, raw: str, out: str, zone: str | None = None, locale: str | None = None, day_column: bool = False
) -> DataFrame:
    """Adds `out`: milliseconds since 1970 (BIGINT) that the text in `raw` gives, finer digits cut off; else null.

    A zone in the text wins; otherwise the IANA name in column `zone` holds, and without either there is no
    instant. A local time that occurs twice is the earlier instant, one that is skipped moves on by the gap.
    Bare numbers count from 1970; their size tells seconds, milli-, micro- or nanoseconds. With `day_column`,
    dates without a time stand for 00:00 UTC, small numbers are spreadsheet days, and `locale` orders day and
    month (en-US: month first). Impossible dates, unknown zones, empty texts and nulls give null.
    """
    text = F.trim(F.regexp_replace(F.col(raw), r"[\u00a0\u2007\u202f]", " "))
    cases = list(_STAMPS)
    if day_column:
        cases += _DAYS
    parts = F.lit(None).cast("string")
    for pattern, template in reversed(cases):
        parts = F.when(F.col("_t").rlike(pattern), F.regexp_replace("_t", pattern, template)).otherwise(parts)
    if day_column:
        first = F.when(F.col(locale) == "en-US", F.lit("$4|$1|$3|0|0|0||")).otherwise(F.lit("$4|$3|$1|0|0|0||")) if locale else F.lit("$4|$3|$1|0|0|0||")
        parts = F.when(F.col("_t").rlike(_NUMERIC_DAY), F.regexp_replace(F.col("_t"), F.lit(_NUMERIC_DAY), first)).when(
            F.col("_t").rlike(_COMPACT_DAY), F.regexp_replace("_t", _COMPACT_DAY, "$1|$2|$3|0|0|0||")
        ).otherwise(parts)

    number = F.when(F.col("_t").rlike(_NUMBER) & F.col("_p").isNull(), F.expr("try_cast(_t AS DECIMAL(38, 9))"))
    df = df.withColumn("_t", text).withColumn("_p", F.split(parts, r"\|")).withColumn("_n", number)

    ints = {n: f"try_cast(_p[{i}] AS INT)" for n, i in (("_y", 0), ("_d", 2), ("_h", 3), ("_i", 4))}
    df = df.withColumns(
        {n: F.expr(e) for n, e in ints.items()}
        | {
            "_m": F.expr(f"coalesce(try_cast(_p[1] AS INT), IF(locate(lower(left(_p[1], 3)), '{_MONTHS}') % 3 = 1, (locate(lower(left(_p[1], 3)), '{_MONTHS}') + 2) div 3, NULL))"),
            "_s": F.expr("IF(_p[5] = '', 0, try_cast(_p[5] AS INT))"),
            "_f": F.expr("IF(_p[6] = '', 0, try_cast(rpad(left(_p[6], 3), 3, '0') AS INT))"),
            "_z": F.expr("upper(_p[7])"),
        }
    )
    length = "CASE WHEN _m IN (4, 6, 9, 11) THEN 30 WHEN _m = 2 THEN IF(_y % 4 = 0 AND (_y % 100 <> 0 OR _y % 400 = 0), 29, 28) ELSE 31 END"
    valid = f"_y BETWEEN 1 AND 9999 AND _m BETWEEN 1 AND 12 AND _d BETWEEN 1 AND {length} AND _h BETWEEN 0 AND 23 AND _i BETWEEN 0 AND 59 AND _s BETWEEN 0 AND 59"
    local = f"CASE WHEN {valid} THEN CAST({_days('_y', '_m', '_d')} AS BIGINT) * 86400000 + _h * 3600000L + _i * 60000L + _s * 1000L + _f END"
    offset = "CASE WHEN _z IN ('Z', 'UTC', 'GMT') THEN 0L WHEN _z <> '' THEN IF(left(_z, 1) = '-', -1L, 1L) * (CAST(substring(_z, 2, 2) AS BIGINT) * 3600000L + IF(length(_z) > 3, CAST(right(_z, 2) AS BIGINT), 0L) * 60000L) END"
    df = df.withColumn("_l", F.expr(local)).withColumn("_o", F.expr(offset))

    if day_column:
        zoned = F.coalesce(F.col("_l") - F.col("_o"), F.col("_l"))
    elif zone:
        known = F.expr(f"`{zone}` IN ({', '.join(repr(z) for z in sorted(available_timezones()))})")
        zoned = F.when(F.col("_o").isNotNull(), F.col("_l") - F.col("_o")).when(
            known, F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(F.col("_l")), F.col(zone)))
        )
    else:
        zoned = F.col("_l") - F.col("_o")
    counted = "CAST(CASE WHEN _n < 1e11BD THEN floor(_n * 1000) WHEN _n < 1e14BD THEN floor(_n) WHEN _n < 1e17BD THEN floor(_n / 1000) WHEN _n < 1e20BD THEN floor(_n / 1000000) END AS BIGINT)"
    if day_column:
        counted = f"CASE WHEN _n < {_SERIAL_LIMIT} THEN CAST(floor((_n - {_SERIAL_EPOCH}) * 86400000) AS BIGINT) ELSE {counted} END"
    df = df.withColumn(out, F.coalesce(zoned, F.expr(counted)))
    return df.drop("_t", "_p", "_n", "_y", "_m", "_d", "_h", "_i", "_s", "_f", "_z", "_l", "_o")


def utc_text(millis: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` in UTC of milliseconds since 1970, whatever the session's zone; null stays null."""
    day = F.floor(millis / 86_400_000).cast("int")
    sec = F.floor(F.pmod(millis, F.lit(86_400_000)) / 1000).cast("int")
    clock = F.format_string("%02d:%02d:%02d", F.floor(sec / 3600).cast("int"), F.floor(F.pmod(sec, F.lit(3600)) / 60).cast("int"), F.pmod(sec, F.lit(60)))
    return F.when(millis.isNotNull(), F.concat_ws(" ", F.date_from_unix_date(day).cast("string"), clock))
