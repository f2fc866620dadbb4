"""Falsy coalescing, whitespace handling and the timestamp ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrays import let

# The characters a general whitespace trim removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The time keys of an item, in the order they are tried.
TIME_KEYS = ("created_at", "createdAt", "created", "timestamp", "time", "updated_at", "updatedAt")

LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"

_MIN_SECOND, _MAX_SECOND = -62135596800, 253402300799
_ISO = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"


def strip(col: Column) -> Column:
    """Trim all Unicode whitespace on both sides."""
    return F.btrim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    """Trim all Unicode whitespace on the right."""
    return F.rtrim(col, F.lit(WHITESPACE))


def first_truthy(*cols: Column, default: str | None = None) -> Column:
    """First value that is neither NULL nor the empty string."""
    parts = [F.nullif(c.cast("string"), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def column_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """Column ``name`` of ``df``, or a typed NULL where the dump lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def single_line(*cols: Column) -> Column:
    """First non-empty text, trimmed, line feeds turned into spaces."""
    return F.replace(strip(first_truthy(*cols, default="")), F.lit("\n"), F.lit(" "))


def truncate(col: Column, limit: int) -> Column:
    """Trim; text over ``limit`` keeps ``limit - 20`` characters plus a marker."""
    text = strip(col)
    cut = F.concat(rstrip(F.substring(text, 1, max(0, limit - 20))), F.lit("\n...[truncated]"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def lines_of(col: Column) -> Column:
    """Lines of a text; a final line break adds no empty line. One pass over the text."""
    last = lambda found: F.get(found, F.size(found) - 1)
    return let(F.split(col, LINE_BREAK), lambda found: F.when(last(found) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found))


def epoch_moment(number: Column) -> Column:
    """Timestamp of an epoch in ns (>1e18), ms (>1e12) or s; out of range is NULL."""
    value = number.cast("double")
    seconds = F.when(value > 1e18, value / 1e9).when(value > 1e12, value / 1e3).otherwise(value)
    micros = F.bround(seconds * 1e6).cast("bigint")
    return F.when(seconds.between(_MIN_SECOND, _MAX_SECOND), F.timestamp_micros(micros))


def nanos_moment(nanos: Column) -> Column:
    """Timestamp of a nanosecond epoch, whatever its magnitude."""
    seconds = nanos.try_cast("bigint") / F.lit(1e9)
    inside = seconds.between(_MIN_SECOND, _MAX_SECOND)
    return F.when(inside, F.timestamp_micros(F.bround(seconds * 1e6).cast("bigint")))


def text_moment(text: Column) -> Column:
    """Timestamp of an ISO text (no zone means UTC) or of a number as text."""
    value = strip(text)
    compact = value.rlike(r"^\d{8}$")
    iso_text = F.when(compact, F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(value)
    iso_text = F.regexp_replace(iso_text, r"^(.{10}[ T]\d{2})(Z|[+-].*)?$", "$1:00$2")
    iso_text = F.regexp_replace(iso_text, r"^(.{10}[ T]\d{2}:\d{2})(Z|[+-].*)?$", "$1:00$2")
    iso_text = F.regexp_replace(iso_text, ",", ".")
    zoned = F.when(iso_text.rlike(r"^.{10,}(Z|[+-]\d{2}(:?\d{2})?)$") & (F.length(iso_text) > 10), iso_text)
    naive = F.when(F.length(iso_text) == 10, F.concat(iso_text, F.lit("T00:00:00Z"))).otherwise(
        F.concat(iso_text, F.lit("Z"))
    )
    as_time = F.when(iso_text.rlike(_ISO), F.coalesce(zoned, naive).try_cast("timestamp"))
    return F.coalesce(as_time, epoch_moment(value.try_cast("double")))


# Month and zone names of RFC 822 dates.
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_ZONES = {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
_MAIL_DATE = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4}|\d{2})\s+(\d{2}:\d{2})(:\d{2})?\s*([A-Z]{1,3}|[+-]\d{2}:?\d{2})?$"


def feed_moment(text: Column) -> Column:
    """Timestamp of a feed date: RFC 822 (``Wed, 24 Apr 2024 09:00:00 +0900``) or anything ``text_moment`` takes."""
    value = strip(text)
    part = lambda n: F.regexp_extract(value, _MAIL_DATE, n)
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in _MONTHS]), F.lower(part(2)))
    year = F.when(F.length(part(3)) == 4, part(3)).when(part(3) < "70", F.concat(F.lit("20"), part(3))).otherwise(F.concat(F.lit("19"), part(3)))
    zone = F.coalesce(*[F.when(part(6) == name, offset) for name, offset in _ZONES.items()], F.when(part(6).rlike(r"^[+-]"), part(6)), F.lit("Z"))
    zone = F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2")
    seconds = F.when(part(5) == "", ":00").otherwise(part(5))
    iso = F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), seconds, zone)
    return F.coalesce(F.when(value.rlike(_MAIL_DATE), iso.try_cast("timestamp")), text_moment(text))


def moment(col: Column, dtype: str) -> Column:
    """Timestamp ladder for a column of the given simple type name."""
    if dtype.startswith("timestamp"):
        return col.cast("timestamp")
    return text_moment(col) if dtype == "string" else epoch_moment(col)


def item_moment(df: DataFrame, keys: tuple[str, ...] = TIME_KEYS) -> Column:
    """First parseable time among the item's time keys."""
    types = dict(df.dtypes)
    found = [moment(F.col(key), types[key]) for key in keys if key in types]
    return F.coalesce(*found) if found else F.lit(None).cast("timestamp")


def iso_utc(ts: Column) -> Column:
    """ISO 8601 text of a timestamp with the UTC offset spelled out."""
    ts = ts.cast("timestamp")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(base, fraction, F.lit("+00:00"))
