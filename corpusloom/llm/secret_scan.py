"""Secret scans with corpus-wide ownership frequency.

Candidate credentials of every text are hashed; the hashes are aggregated by the distinct owners and
repositories that hold them. A value that many owners hold is a widely copied example; one that a single owner
holds in few repositories and that looks random is a live-looking credential of that owner; one that a single owner
holds in many repositories is the owner's own boilerplate, shared and not live.

Defined cases: a null or empty text has no spans; a null owner or repository counts as one of its own ('');
a row is known by its id and its text, so rows that share an id, and rows without one, keep their own spans; rows that
repeat are scanned alike and count once in the frequencies; texts are scanned whole at any length;
an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, materialise, with_names

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the frequency method may add: long opaque words that no base pattern found.
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "opaque")

FOUND = "id {id}, of string, owner string, repository string, spans array<struct<kind:int,start:long,stop:long,value:string,opaque:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, stop, value) of the base patterns, by start and then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(value: str, least_bits: float = 2.5) -> bool:
    """Digits and letters mixed, with at least ``least_bits`` of entropy a character."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= least_bits


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking words that overlap no base span."""
    out, at = [], 0
    for m in OPAQUE.finditer(text):
        while at < len(taken) and taken[at][2] <= m.start():
            at += 1
        if not any(s < m.end() and e > m.start() for s, _, e, _ in taken[at : at + 3]) and looks_random(m[0], 3.5):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("opaque", pa.bool_())]))
    rows = []
    for text in batch.column("text").to_pylist():
        base = base_spans(text) if text else []
        spans = base + (opaque_spans(text, base) if text else [])
        # values go on as digests: the credentials themselves are not copied around
        rows.append([{"kind": k, "start": s, "stop": e, "value": hashlib.md5(v.encode()).hexdigest(), "opaque": looks_random(v)} for s, k, e, v in spans])
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "of", "owner", "repository")), pa.array(rows, kind)], names=["id", "of", "owner", "repository", "spans"])


def of_text(text: Column) -> Column:
    """128 bits of a text, which tell the texts of one id apart."""
    return F.md5(F.coalesce(text, F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "owner", repository_col: str = "repository", min_owners: int = 5, many_repositories: int = 4) -> DataFrame:
    """One row per document: ``id``, ``of`` (of its text), ``spans`` (kind, start, stop, value digest, class), by start and then kind.

    Classes: ``example`` (held by ``min_owners`` owners or more), ``live`` (one owner, fewer than ``many_repositories``
    of its repositories, looks random) and ``shared`` (the rest). Base spans always stay; an opaque word is a span only where it is ``live``.
    The frequency counts distinct (value, owner, repository) triples, pre-aggregated before the shuffle, so a
    value that a third of all rows hold costs each task one row.
    """
    docs = with_names(docs, id=id_col, text=text_col, owner=owner_col, repository=repository_col).withColumn("of", of_text(F.col("text")))
    kind = docs.schema["id"].dataType.simpleString()
    found = materialise(map_batches(docs, _scan, FOUND.format(id=kind)))
    each = found.where("size(spans) > 0").select("id", "of", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"), F.explode("spans").alias("s"))
    held = each.select("s.value", "owner", "repository").distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("n"))
    frequency = by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    spans = each.select("id", "of", "s.*").join(frequency, "value")
    state = F.when(F.col("n_owners") >= min_owners, "example").when((F.col("n_owners") == 1) & (F.col("n_repositories") < many_repositories) & F.col("opaque"), "live").otherwise("shared")
    spans = spans.withColumn("class", state).where("kind < 3 or class = 'live'")
    # a row that repeats brings its spans once more: one of each
    grouped = spans.groupBy("id", "of").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "stop", "value", "class", "n_owners", "n_repositories"))).alias("spans"))
    none = F.from_json(F.lit("[]"), grouped.schema["spans"].dataType)
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.of") == F.col("r.of"))
    both = found.select("id", "of").alias("l").join(grouped.alias("r"), same, "left")
    return both.select("l.id", "l.of", F.coalesce("r.spans", none).alias("spans"))


def joined(spans: F.Column) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s result."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    classed = lambda c: F.size(F.filter("spans", lambda s: s["class"] == c)).cast("long")
    most = lambda c: F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).cast("long")
    return scanned.select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        classed("example").alias("n_example"),
        classed("live").alias("n_live"),
        most("n_owners").alias("max_owners"),
        most("n_repositories").alias("max_repositories"),
    )


def mask_spans(text: str, spans: list[dict], mask: str) -> str:
    """``text`` with each span (by start) as ``mask``; spans that overlap or meet inside one another are one."""
    out, at = [], 0
    for span in spans:
        start, stop = span["start"], span["stop"]
        if stop <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = stop
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span that is not a widely copied example replaced by ``mask``; all columns stay.

    Only documents that have such spans take part in the shuffle's other side; overlapping spans are masked as one.
    """
    @F.arrow_udf("string")
    def masked(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else mask_spans(t, s, mask) for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    own = F.filter("spans", lambda s: s["class"] != "example")
    keys = scanned.select("id", "of", F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans")).where("size(spans) > 0")
    cut = keys.dropDuplicates(["id", "of"]).alias("r")
    text = F.col(f"`{text_col}`")
    # a row goes along whole, so that its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), of_text(text).alias("of")).alias("l")
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.of") == F.col("r.of"))
    both = rows.join(cut, same, "left").select("row", "spans")
    # of rows without spans nothing goes to Python
    new = both.select("row", "spans", masked(F.when(F.col("spans").isNotNull(), F.col(f"row.`{text_col}`")), F.col("spans")).alias("new"))
    return new.select(*[F.when(F.col("spans").isNull(), F.col(f"row.`{c}`")).otherwise(F.col("new")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
