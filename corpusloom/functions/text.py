"""Text expressions over captured bodies and stored pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible_text(html: Column) -> Column:
    """What a reader sees: no scripts, styles and tags, white space collapsed."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", " "), r"\s+", " "))


def looks_like_openapi(body: Column) -> Column:
    head = F.left(F.ltrim(body), F.lit(2000))
    return head.rlike(r'"openapi"|"swagger"|(?m)^(openapi|swagger)\s*:')


def result_kind(header: Column) -> Column:
    """The kind that a provenance header names, with families folded."""
    found = F.trim(F.regexp_extract(header, r"\| type: ([^|>]*?) *\|", 1))
    return F.when(found.startswith("github"), "github").when(found.startswith("llms"), "llms").otherwise(found)


def stamp(url: Column, kind: Column, at: Column, body: Column) -> Column:
    return F.concat(F.lit("<!-- source: "), url, F.lit(" | type: "), kind, F.lit(" | scraped: "), at, F.lit(" -->\n\n"), body)


def strip_stamp(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"(?s)^<!-- source:.*?-->\n+", "")


def truncated(text: Column, limit: int) -> Column:
    """Cut at ``limit``, back to the last line end, with the number of characters left out."""
    head = F.left(text, F.lit(limit))
    cut = F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*)\n", 1), F.lit("")), head)
    note = F.concat(F.lit("\n\n[... "), (F.length(text) - F.length(cut)).cast("string"), F.lit(" characters omitted]"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, note))


def without_repeated_title(body: Column, title: Column) -> Column:
    """Without an opening heading that repeats the title, or the title without its site suffix."""
    heading = F.trim(F.regexp_extract(body, r"^\s*#{1,2}[ \t]+([^\n]*)", 1))
    short = F.regexp_replace(title, r"\s+[|·–—-]\s+[^|·–—-]*$", "")
    same = (heading != "") & ((F.lower(heading) == F.lower(F.trim(title))) | (F.lower(heading) == F.lower(F.trim(short))))
    return F.when(same, F.regexp_replace(body, r"^\s*#{1,2}[ \t]+[^\n]*\n*", "")).otherwise(body)


def cell(text: Column) -> Column:
    """Flattened for a table cell, pipes escaped."""
    return F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("|"), F.lit("\\|"))


def occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle``; none of an empty one."""
    gone = F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))
    return F.when(F.length(needle) == 0, 0).otherwise((gone / F.length(needle)).cast("int"))


def snippet(body: Column, phrase: str, before: int = 90, size: int = 240) -> Column:
    at = F.greatest(F.locate(phrase.lower(), F.lower(body)) - 1 - before, F.lit(0))
    text = F.trim(F.regexp_replace(F.substring(body, at + 1, F.lit(size)), r"\s+", " "))
    return F.concat(F.when(at > 0, "…").otherwise(""), text, F.lit("…"))
