"""Version labels: how they rank, and what a dependency's spec asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELEASE, DATE, UNKNOWN = 2, 1, 0
_RELEASE = r"^[vV]?(\d+(?:\.\d+)*)[-+.]?(.*)$"


def kind(label: Column) -> Column:
    text = F.trim(F.coalesce(label, F.lit("")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), DATE).when(text.rlike(r"^[vV]?\d"), RELEASE).otherwise(UNKNOWN)


def sort_key(label: Column) -> Column:
    """A struct that orders labels newest last: kind, numbers, final before its pre-releases, suffix.

    Labels of no known form all tie.
    """
    text = F.trim(F.coalesce(label, F.lit("")))
    numbers = lambda s, sep: F.transform(F.split(s, sep), lambda x: x.try_cast("bigint"))
    parts = (
        F.when(kind(label) == DATE, numbers(text, "-"))
        .when(kind(label) == RELEASE, numbers(F.regexp_extract(text, _RELEASE, 1), r"\."))
        .otherwise(F.array().cast("array<bigint>"))
    )
    suffix = F.when(kind(label) == RELEASE, F.regexp_extract(text, _RELEASE, 2)).otherwise("")
    final = ((kind(label) == RELEASE) & (suffix == "")).cast("int")
    return F.struct(kind(label).alias("kind"), parts.alias("parts"), final.alias("is_final"), suffix.alias("suffix"))


def why(label: Column) -> Column:
    return F.when(kind(label) == RELEASE, "release number").when(kind(label) == DATE, "harvest date").otherwise("unrecognised label")


def pinned(spec: Column) -> Column:
    return F.regexp_extract(F.coalesce(spec, F.lit("")), r"(\d+(?:\.\d+)*)", 1)


def ladder(pin: Column) -> Column:
    """Labels that may hold a pin's documentation: 3, 2 and 1 parts, plain and then with v, each once."""
    parts = F.split(pin, r"\.")
    cuts = F.array(*[F.array_join(F.slice(parts, 1, n), ".") for n in (3, 2, 1)])
    both = F.flatten(F.transform(cuts, lambda c: F.array(c, F.concat(F.lit("v"), c))))
    return F.when(F.coalesce(pin, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))
