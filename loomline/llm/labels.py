"""Language labels in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that name no language.
PLACEHOLDERS = ("", "auto", "nan", "none", "null", "unknown", "und", "unk", "mul", "zxx", "?", "??", "-", "n/a", "na")


def names_of(lang_sample: DataFrame) -> dict[str, str]:
    """Names and codes of the fixed sample's languages to codes: a table of one entry per language."""
    found: dict[str, str] = {}
    for r in lang_sample.select(F.lower(F.trim("lang")).alias("code"), F.lower(F.trim("lang_name")).alias("name")).filter("code IS NOT NULL").distinct().toLocalIterator():
        found[r["code"]] = r["code"]
        if r["name"]:
            found[r["name"]] = r["code"]
    return found


def label_key(column: Column, lang_sample: DataFrame | dict[str, str]) -> Column:
    """A label as a bare code: lower-case, without region or suffix, names turned to codes; null for a placeholder."""
    names = lang_sample if isinstance(lang_sample, dict) else names_of(lang_sample)
    bare = F.regexp_replace(F.lower(column), r"^[\s ]+|[\s ]+$", "")
    first = F.regexp_extract(bare, r"^([^\-_\s@.]*)", 1)
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    key = F.coalesce(F.try_element_at(known, bare), F.try_element_at(known, first), first)
    return F.when(bare.isNull() | bare.isin(*PLACEHOLDERS) | first.isin(*PLACEHOLDERS), F.lit(None).cast("string")).otherwise(key)
