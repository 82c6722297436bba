"""Lenient readers of text fields: formats, dates, media types, sizes, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes a free-text date may have and the pattern each is read with.
DATE_SHAPES = [
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{8}$", "yyyyMMdd"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}( [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?$", "d MMM yyyy[ H:m:s]"),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}( [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?$", "d MMMM yyyy[ H:m:s]"),
    (r"^[A-Za-z]{4,9} [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
]
ISO_SHAPE = r"^[0-9]{4}(-[0-9]{1,2}(-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?)?)?)?$"

OFFSET = r":[0-9]{1,2}(?:\.[0-9]+)?\s*([+-])([0-9]{2}):?([0-9]{2})\s*$"


def let(c: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn mentions it."""
    return F.get(F.transform(F.array(c), lambda x: fn(x)), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """True for text that is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def normalise_format(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"^\.", "")


def media_type(content_type: Column) -> Column:
    return strip(F.substring_index(content_type, ";", 1))


def mime_or_missing(content_type: Column) -> Column:
    return F.coalesce(media_type(content_type), F.lit("missing"))


def partial_timestamp(c: Column) -> Column:
    """YYYY[MM[DD[HH[MM[SS]]]]] to a timestamp; an odd last digit is ignored, more than 14 are none."""
    used = (F.length(c) - F.length(c) % 2).cast("int")
    rest = F.substring(F.lit("00000101000000"), used + 1, F.lit(14))
    full = F.concat(F.substring(c, F.lit(1), used), rest)
    return F.when(c.rlike(r"^[0-9]{4,14}$"), F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")))


def lenient_datetime(c: Column) -> Column:
    """A whole value that is a date or a date and time, else null; fraction and zone are left out."""
    bare = F.regexp_replace(c, r"^([0-9-]+T[0-9:]+)(?:\.[0-9]*)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$", "$1")
    return let(
        bare,
        lambda x: F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-M-d'T'H:m:s")), F.try_to_timestamp(x, F.lit("yyyy-M-d"))),
    )


def parse_date(c: Column) -> Column:
    """Timestamp (UTC) from free text by a fixed list of patterns, null when none fits.

    A weekday in front and a fraction behind are ignored; an offset behind is applied.
    """
    t = F.regexp_replace(strip(c), r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    t = F.regexp_replace(t, r"(:[0-9]{1,2})(?:\.[0-9]+)?\s*(?:Z|GMT|UTC|[+-][0-9]{2}:?[0-9]{2})?$", "$1")
    def read(x: Column) -> Column:
        out = F.when(x.rlike(ISO_SHAPE), x.try_cast("timestamp"))
        for shape, pattern in DATE_SHAPES:
            out = out.when(x.rlike(shape), F.try_to_timestamp(x, F.lit(pattern)))
        return out

    found = let(t, read)
    behind = lambda group: F.regexp_extract(c, OFFSET, group)
    minutes = behind(2).cast("bigint") * 60 + behind(3).cast("bigint")
    shift = F.when(behind(1) == "-", -minutes).otherwise(minutes)
    utc = F.timestamp_micros(F.unix_micros(found) - shift * 60_000_000)
    return F.when(c.rlike(OFFSET), utc).otherwise(found)


def is_date(c: Column) -> Column:
    return parse_date(c).isNotNull()


def iso_or_text(c: Column) -> Column:
    """ISO form of a date that can be read, the text itself otherwise."""
    return let(c, lambda x: F.coalesce(F.date_format(parse_date(x), "yyyy-MM-dd'T'HH:mm:ss"), x))


def safe_filename(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[^-_.() a-zA-Z0-9]", ""), " ", "_")


def strip_quotes(c: Column) -> Column:
    bare = F.regexp_replace(c, r"(?s)^(['\"])(.*)\1\z", "$2")
    return F.when(c.isin("'", '"'), F.lit("")).otherwise(bare)


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(strip_quotes(c), r"\s+", " "))


def byte_size(c: Column) -> Column:
    """Integer part of a numeric text, null when it is not a number."""
    return c.cast("string").try_cast("double").try_cast("bigint")


def list_items(c: Column) -> Column:
    """A JSON list, a comma separated text or one value, as an array of text."""
    as_json = F.from_json(c, "array<string>")
    return (
        F.when(~filled(c), F.array().cast("array<string>"))
        .when(c.rlike(r"^\s*\[") & as_json.isNotNull(), as_json)
        .otherwise(F.split(c, ","))
    )


def unwrap_label(c: Column) -> Column:
    """The label of a JSON object given as text, or the text."""
    return F.when(
        c.contains('"label"'), F.coalesce(F.get_json_object(c, "$.label"), c)
    ).otherwise(c)


def header_value(header: Column, name: str) -> Column:
    """First value of a header whatever the case of its name."""
    lowered = F.transform_keys(header, lambda k, v: F.lower(k))
    return F.get(F.try_element_at(lowered, F.lit(name.lower())), F.lit(0))


def header_date(header: Column, name: str) -> Column:
    return parse_date(header_value(header, name))


def duration_seconds(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) / 1_000_000 - F.unix_micros(start.cast("timestamp")) / 1_000_000


def duration_label(seconds: Column) -> Column:
    """Hours, minutes and seconds with two decimals, as 01:02:03.00."""
    whole = F.floor(seconds / 60)
    return F.format_string(
        "%02d:%02d:%05.2f",
        F.floor(whole / 60).cast("bigint"),
        (whole % 60).cast("bigint"),
        (seconds - whole * 60).cast("double"),
    )


def tick_label(seconds: Column) -> Column:
    """Days, hours and minutes of an axis tick, days only when there are any."""
    minutes = F.floor(seconds / 60).cast("bigint")
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    short = F.format_string("%dh %dm", hours.cast("bigint"), (minutes % 60).cast("bigint"))
    long = F.format_string(
        "%dd %dh %dm", days.cast("bigint"), (hours % 24).cast("bigint"), (minutes % 60).cast("bigint")
    )
    return F.when(days > 0, long).otherwise(short)
