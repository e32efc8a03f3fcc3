"""Timestamps as columns: milliseconds since 1970 and canonical UTC text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYOUTS = ("iso8601", "rfc3339", "unix_s", "unix_ms", "unix_us", "unix_ns", "java_log")
#: White space around values: the ASCII kinds, the no-break space and the byte order mark.
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"
ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"
_ISO = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?\s*(Z|[+-]\d{2}:?\d{2})?$"
_JAVA = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})[,.](\d{1,3})$"


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone, read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def iso_utc(ms: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.mmmZ, whatever the session's zone."""
    at = F.timestamp_add("MILLISECOND", ms.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_ms(text: Column) -> Column:
    """The milliseconds of canonical text, null where it is not canonical."""
    return F.when(text.rlike(ISO_UTC), _civil_ms(text, _ISO))


def _civil_ms(text: Column, pattern: str) -> Column:
    """Months and days beyond their range roll over, as the data model's parser has it."""
    part = lambda i: F.regexp_extract(text, pattern, i)
    month = part(2).cast("int")
    day = F.date_add(F.add_months(F.make_date(part(1).cast("int"), F.lit(1), F.lit(1)), month - 1), part(3).cast("int") - 1)
    seconds = F.unix_date(day).cast("bigint") * 86400 + part(4).cast("bigint") * 3600 + part(5).cast("bigint") * 60 + part(6).cast("bigint")
    return seconds * 1000 + F.substring(F.rpad(part(7), 3, "0"), 1, 3).cast("bigint")


def _offset(zone: Column) -> Column:
    """Minutes east of UTC; null without a zone."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    return F.when(zone == "Z", 0).when(zone.startswith("-"), -minutes).when(zone.startswith("+"), minutes)


def parse(text: Column, layout: str, assume_offset_minutes: int | None = None) -> Column:
    """struct(ms, offset_minutes, assumed): null fields where text does not fit the layout, or where it
    carries no offset and none is assumed. Fractions are cut to milliseconds, epochs towards zero."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown time layout {layout!r}; one of {', '.join(LAYOUTS)}")
    text = F.btrim(text, F.lit(BLANKS))
    assumed = F.lit(assume_offset_minutes).cast("int")
    if layout.startswith("unix_"):
        number = F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast("decimal(38,0)"))
        per = {"unix_s": F.lit(1000), "unix_ms": F.lit(1), "unix_us": F.lit(1000), "unix_ns": F.lit(1_000_000)}[layout]
        fraction = F.when(text.rlike(r"^[+-]?\d+\.\d+$") & F.lit(layout == "unix_s"), F.floor(F.abs(text.try_cast("double")) * 1000) * F.signum(text.try_cast("double")))
        ms = number * per if layout in ("unix_s", "unix_ms") else F.expr("0") + (F.sign(number) * F.floor(F.abs(number) / per))
        ms = F.coalesce(ms.cast("bigint"), fraction.cast("bigint"))
        return F.struct(ms.alias("ms"), F.when(ms.isNotNull(), 0).alias("offset_minutes"), F.lit(False).alias("assumed"))
    pattern = _JAVA if layout == "java_log" else _ISO
    read = _offset(F.regexp_extract(text, _ISO, 8)) if layout != "java_log" else F.lit(None).cast("int")
    offset = F.coalesce(read, assumed)
    ms = F.when(text.rlike(pattern) & offset.isNotNull(), _civil_ms(text, pattern) - offset.cast("bigint") * 60_000)
    return F.struct(ms.alias("ms"), F.when(ms.isNotNull(), offset).alias("offset_minutes"), (read.isNull() & ms.isNotNull()).alias("assumed"))


def offset_iso(ms: Column, minutes: Column) -> Column:
    """The instant as text in the given offset, which is printed after it."""
    local = F.rtrim(F.regexp_replace(iso_utc(ms + minutes * 60_000), "Z$", ""))
    size = F.abs(minutes)
    return F.concat(local, F.when(minutes < 0, "-").otherwise("+"), F.lpad((size / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))


def bucket_ms(ms: Column, seconds: int) -> Column:
    """The start of the instant's bucket of so many seconds."""
    return F.floor(ms / (seconds * 1000)).cast("bigint") * (seconds * 1000)


def period(ms: Column, minutes: int = 30, offset_minutes: int = 480) -> Column:
    """`start to end` of the tumbling window that holds the instant, on a clock of the given offset."""
    start = bucket_ms(ms + offset_minutes * 60_000, minutes * 60)
    show = lambda c: F.regexp_replace(F.substring(iso_utc(c), 1, 19), "T", " ")
    return F.concat(show(start), F.lit(" to "), show(start + minutes * 60_000))


def window_around(ms: Column, lead_ms: int = 600_000, lag_ms: int = 600_000) -> tuple[Column, Column]:
    """Start and end, as ISO texts, of the time around an instant."""
    return iso_utc(ms - lead_ms), iso_utc(ms + lag_ms)
