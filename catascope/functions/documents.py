"""Field lookups in raw metadata documents held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catascope.functions.text import filled, iso_or_text, list_items, unwrap_label

NO_TEXT = "array<string>"


def _path(key: str) -> str:
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def get(doc: Column, key: str, as_type: str = "string") -> Column:
    """A field of a document; dots go into nested objects."""
    return F.try_variant_get(doc, _path(key), as_type)


def has(doc: Column, key: str) -> Column:
    """The key is there, even if its value is null."""
    return F.try_variant_get(doc, _path(key), "variant").isNotNull()


def elements(doc: Column, key: str) -> Column:
    """A list field as array of VARIANT, empty when there is none."""
    return F.coalesce(get(doc, key, "array<variant>"), F.array().cast("array<variant>"))


def extras_map(doc: Column, key: str = "extras") -> Column:
    """Extras given as a list of key and value or as an object, as one map."""
    pairs = F.filter(elements(doc, key), lambda e: get(e, "key").isNotNull() & has(e, "value"))
    listed = F.map_from_entries(
        F.transform(pairs, lambda e: F.struct(get(e, "key").alias("key"), get(e, "value").alias("value")))
    )
    return F.coalesce(get(doc, key, "map<string,string>"), listed)


def field(doc: Column, extras: Column | None, key: str) -> Column:
    """The key of the document, else of the extras, else with the dcat_ prefix in the extras."""
    own = get(doc, key)
    if extras is None:
        return own
    return F.when(has(doc, key), own).otherwise(
        F.coalesce(F.try_element_at(extras, F.lit(key)), F.try_element_at(extras, F.lit("dcat_" + key)))
    )


def value(doc: Column, extras: Column | None, key: str, *fallbacks: str) -> Column:
    """First filled value of the key and its fallbacks, a JSON label unwrapped."""
    tries = [field(doc, extras, k) for k in (key, *fallbacks)]
    return unwrap_label(F.coalesce(*[F.when(filled(t), t) for t in tries]))


def one(c: Column) -> Column:
    """A value as an array of at most one element."""
    return F.when(filled(c), F.array(F.trim(c))).otherwise(F.array().cast(NO_TEXT))


def values(doc: Column, extras: Column | None, key: str, *fallbacks: str) -> Column:
    return one(value(doc, extras, key, *fallbacks))


def dates(doc: Column, extras: Column | None, key: str, *fallbacks: str) -> Column:
    return one(iso_or_text(value(doc, extras, key, *fallbacks)))


def lists(doc: Column, extras: Column | None, key: str) -> Column:
    return list_items(field(doc, extras, key))
