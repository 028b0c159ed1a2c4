"""Expressions over technology names and candidate URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import urls


def normalise(name: Column) -> Column:
    """The form in which two spellings of a library's name compare."""
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    text = F.when(text.startswith("@"), F.regexp_replace(text, r"^@[^/]*/", "")).otherwise(text)
    text = F.regexp_replace(text, r"[.-](js|ts|py|rs|go|dev|io)$", "")
    return F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def ecosystem(name: Column) -> Column:
    return F.when(name.rlike("^@.*/"), "npm").when(name.contains("::") | name.endswith("-rs"), "crates").otherwise("")


def score(url: Column, field: Column) -> Column:
    """How far a candidate is trusted, by the field that it came out of."""
    return (
        F.when(F.coalesce(url, F.lit("")) == "", 0.0)
        .when(urls.is_forge(url), 0.35)
        .when(field == "documentation", 0.92)
        .when((field == "homepage") & urls.looks_like_docs(url), 0.78)
        .when(field == "homepage", 0.55)
        .otherwise(0.35)
    )
