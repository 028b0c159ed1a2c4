"""API specifications: operations, parameters, request bodies, responses, references and a rendered reference.

A specification is one row (spec_id, body as JSON). What its local references point at is a table of its own
(``targets``), so following one from any node is an equality join on (spec, pointer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.extract import HTTP_METHODS

MOST_HOPS = 10
KEY = ["spec", "path", "method"]


def _entries(json: Column) -> Column:
    """The members of a JSON object in their order, values as JSON; null of anything else."""
    return F.map_entries(F.from_json(json, "map<string,string>"))


def _listed(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def _is_object(json: Column) -> Column:
    return F.startswith(F.ltrim(json), F.lit("{"))


def _reference(node: Column) -> Column:
    return F.get_json_object(node, "$['$ref']")


def _flag(json: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(json, path), F.lit("false")) == "true"


def _said(json: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(json, path), F.lit(""))


def _member(pointer_part: Column) -> Column:
    return F.replace(F.replace(pointer_part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointed_at(specs: DataFrame) -> DataFrame:
    """(spec, pointer, node) of every place that a local reference of the specification's own text names and that exists.

    Pointers sharing a parent are read together: the parent is reached part by part (``aggregate`` over the pointer's
    parts), its members become rows, and those named are kept. Pointers lead through objects only, not into arrays.
    """
    literal = F.regexp_extract_all("body", F.lit(r'"\$ref"\s*:\s*("(?:[^"\\]|\\.)*")'), 1)
    found = F.array_distinct(F.from_json(F.concat(F.lit("["), F.array_join(literal, ","), F.lit("]")), "array<string>"))
    refs = specs.select(F.col("spec_id").alias("spec"), "body", F.explode(F.filter(found, lambda r: F.startswith(r, F.lit("#/")))).alias("pointer"))
    refs = refs.select("spec", "pointer", F.regexp_extract("pointer", r"^(#/(?:.*/)?)[^/]*$", 1).alias("parent"), _member(F.regexp_extract("pointer", r"([^/]*)$", 1)).alias("key"))
    parents = refs.groupBy("spec", "parent").agg(F.collect_set(F.struct("key", "pointer")).alias("wanted"))
    parts = F.split(F.substring("parent", 3, 2**31 - 1), "/")
    inner = F.slice(parts, 1, F.size(parts) - 1)
    walked = parents.join(specs.select(F.col("spec_id").alias("spec"), "body"), "spec").select("spec", "wanted", F.aggregate(inner, F.col("body"), lambda node, p: F.element_at(F.from_json(node, "map<string,string>"), _member(p))).alias("node"))
    members = walked.select("spec", "wanted", F.explode(_entries(F.col("node"))).alias("m")).where("m.value is not null")
    return members.select("spec", F.explode(F.filter("wanted", lambda w: w["key"] == F.col("m.key"))).alias("w"), F.col("m.value").alias("node")).select("spec", "w.pointer", "node")


def targets(specs: DataFrame) -> DataFrame:
    """(spec, pointer, node): ``pointed_at`` with chains followed, at most ten hops from the node that refers to one.

    Only the names of references that lead to references are gathered by specification; a chain that leaves the
    specification, or leads nowhere, ends at its last node, and a cycle after ten hops.
    """
    direct = pointed_at(specs)
    links = direct.select("spec", F.col("pointer").alias("origin"), _reference(F.col("node")).alias("pointer")).where("pointer is not null")
    links = links.join(direct.select("spec", "pointer"), ["spec", "pointer"], "left_semi")
    chains = links.groupBy("spec").agg(F.map_from_entries(F.collect_list(F.struct("origin", "pointer"))).alias("next"))
    hops = F.sequence(F.lit(1), F.lit(MOST_HOPS - 1))
    ends = chains.select("spec", "next", F.explode(F.map_keys("next")).alias("origin"))
    ends = ends.select("spec", "origin", F.aggregate(hops, F.col("origin"), lambda at, _: F.coalesce(F.element_at("next", at), at)).alias("pointer"))
    followed = ends.join(direct, ["spec", "pointer"]).select("spec", F.col("origin").alias("pointer"), "node")
    return direct.join(ends.select("spec", F.col("origin").alias("pointer")), ["spec", "pointer"], "left_anti").unionByName(followed)


def resolve_references(nodes: DataFrame, found: DataFrame, column: str = "node") -> DataFrame:
    """``nodes`` (spec, ..., ``column``) with local references replaced by what they lead to; others stay as they are.

    ``found``: ``targets`` of the specifications. Nodes that are no reference spread over the join by their hash.
    """
    pointer = F.coalesce(_reference(F.col(column)), F.xxhash64(column).cast("string"))
    aim = found.select("spec", F.col("pointer").alias("__pointer"), F.col("node").alias("__target"))
    rows = nodes.withColumn("__pointer", pointer).join(aim, ["spec", "__pointer"], "left")
    return rows.withColumn(column, F.coalesce("__target", column)).select(*nodes.columns)


def operations(specs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(spec, path, method, deprecated, summary, description, media, pos, node, shared, request): one row per operation.

    ``node`` is the operation, ``pos`` its place within its path, ``shared`` its path's parameters, ``request`` its
    request body; paths and request bodies may be references. Paths and methods that are no objects are left out.
    """
    found = targets(specs) if found is None else found
    paths = specs.select(F.col("spec_id").alias("spec"), F.explode(_entries(F.get_json_object("body", "$.paths"))).alias("p"))
    paths = resolve_references(paths.select("spec", F.col("p.key").alias("path"), F.col("p.value").alias("node")).where(_is_object(F.col("node"))), found)
    rows = paths.select("spec", "path", F.get_json_object("node", "$.parameters").alias("shared"), F.posexplode(_entries(F.col("node"))).alias("pos", "m"))
    rows = rows.where(F.lower("m.key").isin(HTTP_METHODS) & _is_object(F.col("m.value")))
    rows = rows.select("spec", "path", F.lower("m.key").alias("method"), "pos", F.col("m.value").alias("node"), "shared", F.get_json_object("m.value", "$.requestBody").alias("request"))
    rows = resolve_references(rows, found, "request")
    content = F.from_json(F.get_json_object("request", "$.content"), "map<string,string>")
    media = F.array_join(F.array_sort(F.coalesce(F.map_keys(content), F.array().cast("array<string>"))), ",")
    node = F.col("node")
    return rows.select(*KEY, _flag(node, "$.deprecated").alias("deprecated"), _said(node, "$.summary").alias("summary"), _said(node, "$.description").alias("description"), media.alias("media"), "pos", "node", "shared", "request")


def type_label(schema: Column, quote: str = "") -> Column:
    """A schema's label: a reference's name, an enumeration, T[] at any depth, a | b, or its type."""
    get = lambda node, path: F.get_json_object(node, path)
    q = F.lit(quote)

    def name(node: Column) -> Column:
        return F.nullif(F.regexp_extract(_reference(node), r"([^/]+)$", 1), F.lit(""))

    def enumeration(node: Column) -> Column:
        return F.nullif(F.array_join(F.from_json(get(node, "$.enum"), "array<string>"), ", "), F.lit(""))

    def is_array(node: Column) -> Column:
        return name(node).isNull() & enumeration(node).isNull() & (F.coalesce(get(node, "$.type"), F.lit("")) == "array")

    deepest = F.sequence(F.lit(0), F.regexp_count(F.coalesce(schema, F.lit("")), F.lit('"array"')))
    start = F.struct(F.coalesce(schema, F.lit("{}")).alias("node"), F.lit("").alias("marks"))
    opened = F.aggregate(deepest, start, lambda s, _: F.when(is_array(s["node"]), F.struct(F.coalesce(get(s["node"], "$.items"), F.lit("{}")).alias("node"), F.concat(s["marks"], F.lit("[]")).alias("marks"))).otherwise(s))

    def of(node: Column) -> Column:
        kinds = F.when(_starts_list(get(node, "$.type")), F.array_join(F.from_json(get(node, "$.type"), "array<string>"), " | "))
        choice = F.lit(None).cast("string")
        for key in ("oneOf", "anyOf", "allOf"):
            part = lambda p: F.coalesce(F.concat(q, name(p), q), get(p, "$.type"), F.lit("any"))
            choice = F.coalesce(choice, F.nullif(F.array_join(F.transform(F.from_json(get(node, f"$.{key}"), "array<string>"), part), " | "), F.lit("")))
        return F.coalesce(F.concat(q, name(node), q), F.concat(F.lit("enum: "), enumeration(node)), kinds, choice, get(node, "$.type"), F.lit("any"))

    return F.element_at(F.transform(F.array(opened), lambda s: F.concat(of(s["node"]), s["marks"])), 1)


def _starts_list(json: Column) -> Column:
    return F.startswith(F.ltrim(json), F.lit("["))


def parameters(specs: DataFrame, found: DataFrame | None = None, quote: str = "") -> DataFrame:
    """(spec, path, method, pos, name, place, type, required, description): a path's parameters, then the operation's own.

    Parameters and their schemas may be references. Of equal (name, place) the last wins, in the first one's place.
    """
    found = targets(specs) if found is None else found
    listed = F.concat(_listed(F.col("shared")), _listed(F.get_json_object("node", "$.parameters")))
    rows = operations(specs, found).select(*KEY, F.posexplode(listed).alias("pos", "node")).where(_is_object(F.col("node")))
    rows = resolve_references(rows, found)
    get = lambda path: F.get_json_object("node", path)
    rows = rows.select(*KEY, "pos", get("$.name").alias("name"), get("$.in").alias("place"), get("$.schema").alias("schema"), _flag(F.col("node"), "$.required").alias("required"), _said(F.col("node"), "$.description").alias("description"), get("$.type").alias("plain"))
    best = rows.where("name <> ''").groupBy(*KEY, "name", "place").agg(F.min("pos").alias("first"), F.max_by(F.struct("schema", "plain", "required", "description"), "pos").alias("d"))
    best = resolve_references(best.select(*KEY, F.col("first").alias("pos"), "name", "place", "d.*"), found, "schema")
    # without a schema the type stands in the parameter itself, as in older specifications
    label = F.when(F.col("schema").isNull() & F.col("plain").isNotNull(), F.col("plain")).otherwise(type_label(F.col("schema"), quote))
    return best.select(*KEY, "pos", "name", "place", label.alias("type"), "required", "description")


def request_bodies(specs: DataFrame, found: DataFrame | None = None, quote: str = "") -> DataFrame:
    """(spec, path, method, required, pos, media, type): one row for each media type of a request body, null ones if it has none."""
    rows = operations(specs, found).where(_is_object(F.col("request")) & (F.size(F.from_json("request", "map<string,string>")) > 0))
    rows = rows.select(*KEY, _flag(F.col("request"), "$.required").alias("required"), F.posexplode_outer(_entries(F.get_json_object("request", "$.content"))).alias("pos", "c"))
    schema = F.get_json_object("c.value", "$.schema")
    return rows.select(*KEY, "required", "pos", F.col("c.key").alias("media"), F.when(schema.isNotNull(), type_label(schema, quote)).alias("type"))


def responses(specs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(spec, path, method, pos, code, description) in the order given; a response may be a reference."""
    found = targets(specs) if found is None else found
    rows = operations(specs, found).select(*KEY, F.posexplode(_entries(F.get_json_object("node", "$.responses"))).alias("pos", "r"))
    rows = resolve_references(rows.select(*KEY, "pos", F.col("r.key").alias("code"), F.col("r.value").alias("node")), found)
    return rows.select(*KEY, "pos", "code", _said(F.col("node"), "$.description").alias("description"))


def _in_order(order: list[str], value: str) -> Column:
    """The values of a group in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value")))), lambda x: x["__value"])


def rendered(specs: DataFrame) -> DataFrame:
    """(spec, markdown): title, version, servers, description, then each operation by path with its tables.

    Fixed values: the headings and tables of the format. A specification's text is one row, as its body is; bodies
    that are no JSON object have none.
    """
    specs = specs.where(F.json_object_keys("body").isNotNull())
    found = targets(specs)
    cell = lambda c: text.cell(F.coalesce(F.col(c), F.lit("")))
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    trimmed = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    line = F.concat(F.lit("| "), code(F.col("name")), F.lit(" | "), F.coalesce("place", F.lit("")), F.lit(" | "), F.col("type"), F.lit(" | "), F.when(F.col("required"), "yes").otherwise("no"), F.lit(" | "), cell("description"), F.lit(" |"))
    params = parameters(specs, found, "`").withColumn("line", line).groupBy(*KEY).agg(F.array_join(_in_order(["pos"], "line"), "\n").alias("params"))
    named = F.when(~F.col("type").isin("object", "any"), F.concat(F.lit("\n- "), code(F.col("media")), F.lit(" → "), F.col("type")))
    sent = request_bodies(specs, found, "`").withColumn("kind", code(F.col("media"))).withColumn("named", F.coalesce(named, F.lit("")))
    kinds = F.coalesce(F.nullif(F.array_join(_in_order(["pos"], "kind"), ", "), F.lit("")), F.lit("`—`"))
    sent = sent.groupBy(*KEY).agg(F.concat(F.when(F.any_value("required"), "**Request body (required):** ").otherwise("**Request body:** "), kinds, F.array_join(_in_order(["pos"], "named"), "")).alias("sent"))
    answer = F.concat(F.lit("| "), code(F.col("code")), F.lit(" | "), cell("description"), F.lit(" |"))
    answers = responses(specs, found).withColumn("line", answer).groupBy(*KEY).agg(F.array_join(_in_order(["pos"], "line"), "\n").alias("answers"))
    rows = operations(specs, found).join(params, KEY, "left").join(sent, KEY, "left").join(answers, KEY, "left")
    block = F.concat_ws(
        "\n\n",
        F.concat(F.lit("### "), code(F.concat(F.upper("method"), F.lit(" "), "path"))),
        F.when(F.col("deprecated"), "> **Deprecated**"),
        trimmed("summary"),
        trimmed("description"),
        F.concat(F.lit("| Param | In | Type | Required | Description |\n|---|---|---|---|---|\n"), "params"),
        F.col("sent"),
        F.concat(F.lit("| Response | Description |\n|---|---|\n"), "answers"),
    )
    blocks = rows.withColumn("block", block).groupBy("spec").agg(F.array_join(_in_order(["path", "pos"], "block"), "\n\n").alias("blocks"))
    info = lambda path: F.nullif(F.get_json_object("body", path), F.lit(""))
    servers = F.filter(F.transform(_listed(F.get_json_object("body", "$.servers")), lambda s: F.get_json_object(s, "$.url")), lambda u: u != "")
    head = specs.select(
        F.col("spec_id").alias("spec"),
        F.concat(F.lit("# "), F.coalesce(info("$.info.title"), F.lit("API Reference"))).alias("title"),
        F.concat(F.lit("**Version:** "), info("$.info.version")).alias("version"),
        F.when(F.size(servers) > 0, F.concat(F.lit("**Servers:** "), F.array_join(F.transform(servers, code), ", "))).alias("servers"),
        trimmed(F.get_json_object("body", "$.info.description")).alias("about"),
    )
    whole = F.concat(F.concat_ws("\n\n", "title", "version", "servers", "about", F.lit("## Endpoints"), "blocks"), F.lit("\n"))
    return head.join(blocks, "spec", "left").select("spec", whole.alias("markdown"))
