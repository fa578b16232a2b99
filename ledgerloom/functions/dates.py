"""Dates and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.base import col, lookup, strip

HOME_OFFSET = "+05:30"
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august",
           "september", "october", "november", "december"]
_MONTH_NUMBERS = {
    **{name: i for i, name in enumerate(_MONTHS, 1)},
    **{name[:3]: i for i, name in enumerate(_MONTHS, 1)},
}
_ABSENT = ["", "null", "none", "n/a"]

_TIME = r"(\d{1,2}):(\d{1,2}):(\d{1,2})"
# One pattern per family of layouts, so a value is scanned a few times rather
# than tried against every format in turn.
_ISO = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:T|\s+){_TIME})?$"
_ZONED = (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})T{_TIME}(?:\.(\d{{1,6}}))?"
          r"(Z|[+-]\d{2}:?\d{2})$")
_SLASHED = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:\s+{_TIME})?$"
_DASHED = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
_DAY_FIRST_NAME = rf"^(\d{{1,2}})\s+([A-Za-z]+)\s+(\d{{4}})(?:\s+{_TIME})?$"
_NAME_FIRST = r"^([A-Za-z]+)\s+(\d{1,2})\s+(\d{4})$"


def _whole(text: Column, pattern: str, group: int) -> Column:
    piece = F.regexp_extract(text, pattern, group)
    return F.when(piece != "", piece).otherwise("0").cast("int")


def _instant(y: Column, m: Column, d: Column, hh: Column, mm: Column, ss: Column,
             zone: Column) -> Column:
    return F.try_make_timestamp(y, m, d, hh, mm, ss.cast("decimal(8,6)"), zone)


def parse_instant(value: Column | str, offset: str = HOME_OFFSET) -> Column:
    """Instant of a written date or time; day before month; no zone means ``offset``."""
    text = strip(col(value).cast("string"))
    home, zero = F.lit(offset), F.lit(0)

    def parts(pattern: str, *groups: int) -> list[Column]:
        return [_whole(text, pattern, g) for g in groups]

    iso = _instant(*parts(_ISO, 1, 2, 3, 4, 5, 6), home)

    zone = F.regexp_replace(F.regexp_extract(text, _ZONED, 8), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    zone = F.when(zone == "Z", F.lit("+00:00")).otherwise(zone)
    seconds = F.concat_ws(
        ".", F.regexp_extract(text, _ZONED, 6),
        F.rpad(F.regexp_extract(text, _ZONED, 7), 6, "0"),
    ).try_cast("decimal(8,6)")
    zoned = _instant(*parts(_ZONED, 1, 2, 3, 4, 5), seconds, zone)

    y, a, b = parts(_SLASHED, 3, 1, 2)
    time = parts(_SLASHED, 4, 5, 6)
    day_first = _instant(y, b, a, *time, home)
    month_first = F.when(~text.rlike(r"\s"), _instant(y, a, b, zero, zero, zero, home))
    slashed = F.coalesce(day_first, month_first)

    y, m, d = parts(_DASHED, 3, 2, 1)
    dashed = _instant(y, m, d, zero, zero, zero, home)

    word = F.lower(F.regexp_extract(text, _DAY_FIRST_NAME, 2))
    month = lookup(_MONTH_NUMBERS, word)
    timed = F.regexp_extract(text, _DAY_FIRST_NAME, 4) != ""
    # A clock time is only read after a short month name.
    month = F.when(timed & (F.length(word) != 3), F.lit(None).cast("int")).otherwise(month)
    y, d = parts(_DAY_FIRST_NAME, 3, 1)
    day_name = _instant(y, month, d, *parts(_DAY_FIRST_NAME, 4, 5, 6), home)

    month = lookup(_MONTH_NUMBERS, F.lower(F.regexp_extract(text, _NAME_FIRST, 1)))
    y, d = parts(_NAME_FIRST, 3, 2)
    name_day = _instant(y, month, d, zero, zero, zero, home)

    return (
        F.when(text.rlike(_ISO), iso)
        .when(text.rlike(_ZONED), zoned)
        .when(text.rlike(_SLASHED), slashed)
        .when(text.rlike(_DASHED), dashed)
        .when(text.rlike(_DAY_FIRST_NAME), day_name)
        .when(text.rlike(_NAME_FIRST), name_day)
    )


def date_absent(value: Column | str) -> Column:
    text = strip(col(value).cast("string"))
    return text.isNull() | F.lower(text).isin(_ABSENT)


def instant_error(value: Column | str, field: str, parsed: Column | None = None) -> Column:
    raw = col(value).cast("string")
    read = parse_instant(value) if parsed is None else parsed
    return F.when(
        ~date_absent(value) & read.isNull(),
        F.concat(F.lit(f"DATE_PARSE_ERROR: {field}: "), strip(raw)),
    )


def iso_text(value: Column | str) -> Column:
    """UTC text with an explicit offset; the fraction appears only when there is one."""
    instant = col(value)
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(instant, "SSSSSS")
    return F.concat(
        whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def date_text(value: Column | str) -> Column:
    return F.date_format(col(value), "yyyy-MM-dd")


def floor_day_gap(left: Column | str, right: Column | str) -> Column:
    """Absolute floored day difference of two instants: half a day back counts one."""
    seconds = col(left).cast("double") - col(right).cast("double")
    return F.abs(F.floor(seconds / 86400)).cast("int")


def upload_date(value: Column | str) -> Column:
    """First Y-M-D, else first D-M-Y, found in the text, else its first ten characters."""
    text = strip(col(value).cast("string"))
    ymd = r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})"
    dmy = r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})"
    turned = F.concat_ws(
        "-", F.regexp_extract(text, dmy, 3),
        F.lpad(F.regexp_extract(text, dmy, 2), 2, "0"),
        F.lpad(F.regexp_extract(text, dmy, 1), 2, "0"),
    )
    return (
        F.when(text.rlike(ymd), F.regexp_replace(F.regexp_extract(text, ymd, 1), "/", "-"))
        .when(text.rlike(dmy), turned)
        .when(F.length(text) >= 10, F.substring(text, 1, 10))
    )


def written_date(value: Column | str) -> Column:
    """Calendar date as written in the first ten characters, with no zone shift."""
    head = F.substring(strip(col(value).cast("string")), 1, 10)
    compact = r"^(\d{4})(\d{2})(\d{2})$"
    return (
        F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), head.try_cast("date"))
        .when(head.rlike(compact), F.regexp_replace(head, compact, "$1-$2-$3").try_cast("date"))
    )


def day_gap(left: Column | str, right: Column | str) -> Column:
    """Whole days between two dates, null when either is unknown."""
    return F.abs(F.datediff(col(left), col(right)))
