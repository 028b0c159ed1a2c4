"""API specifications made of parts (X10-X15), chat tables (W8, W9, A9, T1) and streaming ingest (ST1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import apispec as a
from corpusloom.operators import chat
from corpusloom.plans.fixtures import CAPTURES, captures, table
from corpusloom.session import shared_dir
from corpusloom.streaming.ingest import STORED, ingest

QUERIES, ORACLES = {}, {}
PATHS = "paths AS (SELECT p_brand AS spec, '/' || lower(p_type) || '/{id}' AS path, CASE WHEN max(p_size) >= 25 THEN true ELSE false END AS big, min(p_size) AS low FROM part GROUP BY ALL), ops AS (SELECT *, 'get' AS method FROM paths UNION ALL SELECT *, 'post' FROM paths WHERE big)"


def query(name: str, sql: str | None, head: str = PATHS):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = f"WITH {head}{sql if sql[0] == chr(44) else chr(32) + sql}" if head else sql
        return fn

    return register


SHARED = '{"$ref": "#/components/parameters/Id"}'
GET = '{"summary": "Read", "description": "a | b", "parameters": [{"name": "id", "in": "path", "required": true, "schema": {"type": "array", "items": {"$ref": "#/components/schemas/Key"}}, "description": "own"}, {"$ref": "#/components/parameters/Alias"}, {"$ref": "other.json#/x"}], "responses": {"200": {"description": "fine"}, "404": {}}}'
POST = '{"deprecated": true, "requestBody": {"content": {"text/plain": {}, "application/json": {}}}, "responses": {"201": {"description": "made"}}}'
PARTS = '"components": {"parameters": {"Id": {"name": "id", "in": "path", "schema": {"type": "string"}}, "Alias": {"$ref": "#/components/parameters/Limit"}, "Limit": {"name": "limit", "in": "query", "schema": {"oneOf": [{"type": "integer"}, {"$ref": "#/components/schemas/Key"}]}}}, "schemas": {"Key": {"type": "string", "enum": ["a", "b"]}}}'


def specs(spark, d):
    """A JSON specification for each brand: a path for each type, a post where a part is large."""
    paths = table(spark, d, "part").groupBy(F.col("p_brand").alias("spec_id"), F.concat(F.lit("/"), F.lower("p_type"), F.lit("/{id}")).alias("path")).agg((F.max("p_size") >= 25).alias("big"))
    entry = F.concat(F.lit('"'), "path", F.lit(f'": {{"parameters": [{SHARED}], "get": {GET}'), F.when(F.col("big"), F.lit(f', "post": {POST}')).otherwise(""), F.lit(', "x-note": {}}'))
    return paths.groupBy("spec_id").agg(F.concat(F.lit('{"openapi": "3.0", "paths": {'), F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit("}, " + PARTS + "}")).alias("body"))


@query("x10_operations", "SELECT spec, path, method, method = 'post' AS deprecated, CASE method WHEN 'get' THEN 'Read' ELSE '' END AS summary, CASE method WHEN 'get' THEN 'a | b' ELSE '' END AS description, CASE method WHEN 'get' THEN '' ELSE 'application/json,text/plain' END AS media FROM ops")
def x10(spark, d):
    return a.operations(specs(spark, d)).drop("node", "shared", "request", "pos")


@query("x11_parameters", "SELECT spec, path, method, CAST(0 AS INTEGER) AS pos, 'id' AS name, 'path' AS place, CASE method WHEN 'get' THEN 'Key[]' ELSE 'string' END AS type, method = 'get' AS required, CASE method WHEN 'get' THEN 'own' ELSE '' END AS description FROM ops UNION ALL SELECT spec, path, method, 2, 'limit', 'query', 'integer | Key', false, '' FROM ops WHERE method = 'get'")
def x11(spark, d):
    return a.parameters(specs(spark, d)).where("name is not null")


@query("x12_responses", "SELECT spec, path, method, code, description FROM ops, (VALUES ('get', '200', 'fine'), ('get', '404', ''), ('post', '201', 'made')) AS v(m, code, description) WHERE m = method")
def x12(spark, d):
    return a.responses(specs(spark, d)).drop("pos")


@query("x13_references", "SELECT spec, id, CASE id WHEN 'alias' THEN 'limit' WHEN 'id' THEN 'id' END AS name, id = 'foreign' AS kept FROM (SELECT DISTINCT spec FROM paths), (VALUES ('alias'), ('id'), ('foreign')) AS v(id)")
def x13(spark, d):
    s = specs(spark, d)
    refs = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(f'{{"$ref": "{r}"}}').alias("node")) for k, r in (("alias", "#/components/parameters/Alias"), ("id", "#/components/parameters/Id"), ("foreign", "other.json#/x"))])
    rows = s.select(F.col("spec_id").alias("spec"), F.explode(refs).alias("r")).select("spec", "r.id", "r.node")
    found = a.resolve_references(rows, a.targets(s))
    return found.select("spec", "id", F.get_json_object("node", "$.name").alias("name"), F.get_json_object("node", "$['$ref']").isNotNull().alias("kept"))


PARAMS = "| Param | In | Type | Required | Description |\n|---|---|---|---|---|\n"
ANSWERS = "| Response | Description |\n|---|---|\n"
GET_TEXT = f"Read\n\na | b\n\n{PARAMS}| `id` | path | `Key`[] | yes | own |\n| `limit` | query | integer | `Key` | no |  |\n\n{ANSWERS}| `200` | fine |\n| `404` |  |"
POST_TEXT = f"> **Deprecated**\n\n{PARAMS}| `id` | path | string | no |  |\n\n**Request body:** `text/plain`, `application/json`\n\n{ANSWERS}| `201` | made |"


def joined(order: str) -> str:
    return f"string_agg('### `' || upper(method) || ' ' || path || '`' || chr(10) || chr(10) || said, chr(10) || chr(10) ORDER BY {order})"


@query("x15_rendered_reference", f""", said AS (SELECT *, CASE method WHEN 'get' THEN '{GET_TEXT}' ELSE '{POST_TEXT}' END AS said FROM ops)
  SELECT spec, '# API Reference' || chr(10) || chr(10) || '## Endpoints' || chr(10) || chr(10) || {joined("path, method")} || chr(10) AS markdown FROM said GROUP BY spec""")
def x15(spark, d):
    return a.rendered(specs(spark, d))


# specifications whose paths, parameters, schemas, bodies and responses are references, also by chains and in circles
LINKED = "linked AS (SELECT p_brand AS spec, '/~' || lower(p_type) AS path, count(*) AS n, max(p_size) AS size FROM part GROUP BY ALL), named AS (SELECT spec, path, n, size, n % 3 = 0 AS based FROM linked UNION ALL SELECT DISTINCT spec, '/base', 0, 0, true FROM linked), ops AS (SELECT spec, path, CASE WHEN based THEN 'get' ELSE 'post' END AS method, n, size FROM named)"
NESTED = '{"type": ["string", "null"]}'
for _ in range(5):
    NESTED = f'{{"type": "array", "items": {NESTED}}}'
BASE = f'{{"parameters": [{{"$ref": "#/parameters/L"}}], "GET": {{"summary": "Base", "parameters": [{{"name": "deep", "in": "query", "schema": {NESTED}}}, {{"name": "kind", "in": "query", "required": true, "schema": {{"$ref": "#/definitions/Kind"}}}}], "responses": {{"200": {{"$ref": "#/responses/Fine"}}}}}}, "head": "none"}}'
CHAIN = ", ".join(f'"c{i}": {{"$ref": "#/x~1hops/c{i + 1}"}}' for i in range(11)) + ', "c11": {"description": "end"}, "loop": {"$ref": "#/x~1hops/loop"}'
REST = '"parameters": {"L": {"name": "limit", "in": "query", "type": "integer"}}, "definitions": {"Kind": {"type": "string", "enum": ["a", "b"]}, "Row": {"type": "object"}}, "responses": {"Fine": {"description": "all | fine"}}, "x/hops": {' + CHAIN + '}, "components": {"requestBodies": {"B": {"required": true, "content": {"text/csv": {"schema": {"$ref": "#/definitions/Row"}}, "application/json": {"schema": {"type": "array", "items": {"$ref": "#/definitions/Row"}}}, "text/plain": {"schema": {"type": "object"}}}}}}'
SENT = '"requestBody": {"$ref": "#/components/requestBodies/B"}, "responses": {"201": {"$ref": "#/x~1hops/c2"}, "202": {"$ref": "#/x~1hops/c1"}, "203": {"$ref": "#/x~1hops/loop"}, "204": {"$ref": "#/nowhere/at/all"}, "205": {"$ref": "#\\/responses\\/Fine"}}'


def linked_specs(spark, d):
    """A specification for each brand: a path for each type, a third of them references to one path."""
    paths = table(spark, d, "part").groupBy(F.col("p_brand").alias("spec_id"), F.concat(F.lit("/~"), F.lower("p_type")).alias("path")).agg(F.count("*").alias("n"), F.max("p_size").alias("size"))
    own = F.concat(F.lit('{"parameters": [{"$ref": "#/parameters/L"}, 7], "post": {"summary": "'), F.col("n").cast("string"), F.lit(' parts", "description": "up to '), F.col("size").cast("string"), F.lit('", ' + SENT + "}}"))
    entry = F.concat(F.lit('"'), "path", F.lit('": '), F.when(F.col("n") % 3 == 0, '{"$ref": "#/paths/~1base"}').otherwise(own))
    info = F.concat(F.lit('{"swagger": "2.0", "info": {"title": "Parts", "version": "'), F.sum("n").cast("string"), F.lit('", "description": " All parts.\\n"}, "servers": [{"url": "https://parts.example.dev"}, {}], ' + REST + f', "paths": {{"/base": {BASE}, "/void": null, "/word": "x", '))
    return paths.groupBy("spec_id").agg(F.concat(info, F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit("}}")).alias("body"))


@query("x10_linked_operations", "SELECT spec, path, method, false AS deprecated, CASE method WHEN 'get' THEN 'Base' ELSE n || ' parts' END AS summary, CASE method WHEN 'get' THEN '' ELSE 'up to ' || size END AS description, CASE method WHEN 'get' THEN '' ELSE 'application/json,text/csv,text/plain' END AS media FROM ops", LINKED)
def x10_linked(spark, d):
    return a.operations(linked_specs(spark, d)).drop("node", "shared", "request", "pos")


@query("x11_x14_linked_parameters", "SELECT spec, path, method, CAST(pos AS INTEGER) AS pos, name, 'query' AS place, type, name = 'kind' AS required, '' AS description FROM ops, (VALUES ('get', 0, 'limit', 'integer'), ('get', 1, 'deep', 'string | null[][][][][]'), ('get', 2, 'kind', 'enum: a, b'), ('post', 0, 'limit', 'integer')) AS v(m, pos, name, type) WHERE m = method", LINKED)
def x11_linked(spark, d):
    return a.parameters(linked_specs(spark, d))


@query("x12_linked_responses", "SELECT spec, path, method, code, description FROM ops, (VALUES ('get', '200', 'all | fine'), ('post', '201', 'end'), ('post', '202', ''), ('post', '203', ''), ('post', '204', ''), ('post', '205', 'all | fine')) AS v(m, code, description) WHERE m = method", LINKED)
def x12_linked(spark, d):
    return a.responses(linked_specs(spark, d)).drop("pos")


@query("x10_request_bodies", "SELECT spec, path, method, true AS required, CAST(pos AS INTEGER) AS pos, media, type FROM ops, (VALUES (0, 'text/csv', 'Row'), (1, 'application/json', 'Row[]'), (2, 'text/plain', 'object')) AS v(pos, media, type) WHERE method = 'post'", LINKED)
def x10_bodies(spark, d):
    return a.request_bodies(linked_specs(spark, d))


@query("x13_pointers", """SELECT DISTINCT spec, pointer, ref IS NULL AS resolved FROM linked, (SELECT '#/x~1hops/c' || i AS pointer, CASE WHEN i = 0 THEN '#/x~1hops/c10' WHEN i = 1 THEN '#/x~1hops/c11' END AS ref FROM range(1, 12) AS r(i)
  UNION ALL SELECT * FROM (VALUES ('#/x~1hops/loop', '#/x~1hops/loop'), ('#/parameters/L', NULL), ('#/definitions/Kind', NULL), ('#/definitions/Row', NULL), ('#/responses/Fine', NULL), ('#/components/requestBodies/B', NULL)))
  UNION ALL SELECT DISTINCT spec, '#/paths/~1base', true FROM linked WHERE n % 3 = 0""", LINKED)
def x13_pointers(spark, d):
    return a.targets(linked_specs(spark, d)).select("spec", "pointer", F.get_json_object("node", "$['$ref']").isNull().alias("resolved"))


BASE_TEXT = f"Base\n\n{PARAMS}| `limit` | query | integer | no |  |\n| `deep` | query | string | null[][][][][] | no |  |\n| `kind` | query | enum: a, b | yes |  |\n\n{ANSWERS}| `200` | all \\| fine |"
SENT_TEXT = f"{PARAMS}| `limit` | query | integer | no |  |\n\n**Request body (required):** `text/csv`, `application/json`, `text/plain`\n- `text/csv` → `Row`\n- `application/json` → `Row`[]\n\n{ANSWERS}| `201` | end |\n| `202` |  |\n| `203` |  |\n| `204` |  |\n| `205` | all \\| fine |"


@query("x15_linked_reference", f""", said AS (SELECT *, CASE method WHEN 'get' THEN '{BASE_TEXT}' ELSE n || ' parts' || chr(10) || chr(10) || 'up to ' || size || chr(10) || chr(10) || '{SENT_TEXT}' END AS said FROM ops)
  SELECT spec, '# Parts' || chr(10) || chr(10) || '**Version:** ' || sum(n) || chr(10) || chr(10) || '**Servers:** `https://parts.example.dev`' || chr(10) || chr(10) || 'All parts.' || chr(10) || chr(10) || '## Endpoints' || chr(10) || chr(10) || {joined("path")} || chr(10) AS markdown FROM said GROUP BY spec""", LINKED)
def x15_linked(spark, d):
    return a.rendered(linked_specs(spark, d))


def long_chats(spark, d):
    """Conversations repeated six times over, with blanks, so that some pass 40 messages."""
    c = table(spark, d, "conversations").where("text is not null")
    rows = c.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    blank = (F.col("turn") + F.col("k")) % 7 == 3
    return rows.select("conv_id", (F.col("turn") + F.col("k") * 8).alias("turn"), "role", F.when(blank, "  ").otherwise(F.col("text")).alias("text"))


CHATS = "chats AS (SELECT conv_id, turn + k * 8 AS turn, role, CASE WHEN (turn + k) % 7 = 3 THEN '  ' ELSE text END AS text FROM conversations, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) WHERE text IS NOT NULL)"
HISTORY = CHATS + ", history AS (SELECT conv_id, turn, role, left(text, 100000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM chats) WHERE rank <= 40 AND role IN ('user', 'assistant') AND trim(text) <> '')"


@query("w8_chat_history", "SELECT conv_id, turn, role, length(text) AS size FROM history", HISTORY)
def w8(spark, d):
    return chat.history(long_chats(spark, d)).select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))


@query("w9_transcript", ", n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS many FROM history) SELECT conv_id, sha256(CASE WHEN max(many) = 1 THEN min(text) ELSE string_agg(CASE WHEN back > 1 AND role = 'assistant' THEN 'Assistant: ' ELSE 'User: ' END || text, chr(10) || chr(10) ORDER BY turn) END) AS text_sha256 FROM n GROUP BY conv_id", HISTORY)
def w9(spark, d):
    return chat.transcript(chat.history(long_chats(spark, d))).select("conv_id", F.sha2("text", 256).alias("text_sha256"))


@query("t1_result_summary", "SELECT conv_id, turn, conv_id % 5 <> 0 AS ok, length(text) + CASE WHEN conv_id % 5 = 0 THEN 6 ELSE 0 END AS size, left(CASE WHEN conv_id % 5 = 0 THEN 'Error:' || text ELSE text END, 200) AS head FROM conversations WHERE text IS NOT NULL", "")
def t1(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    result = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("Error:"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", chat.result_summary(result).alias("r")).select("conv_id", "turn", "r.*")


@query("a9_joined_fragments", "SELECT doc_id, sha256(text) AS text_sha256, CAST(ceil(length(text) / 100.0) AS BIGINT) AS pieces FROM documents WHERE length(text) > 0", "")
def a9(spark, d):
    docs = table(spark, d, "documents").where("length(text) > 0")
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 100).cast("int") - 1)).alias("seq"))
    pieces = rows.select("doc_id", "seq", F.substring("text", F.col("seq") * 100 + 1, F.lit(100)).alias("piece"))
    return chat.joined_fragments(pieces, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "pieces")


@query("st1_streaming_ingest", None, "")
def st1(spark, d):
    """The store that streaming ingest leaves after all captures; equal to a batch over them."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    rows = captures(spark, d).withColumn("harvested_at", F.lit("2026-08-20").cast("timestamp"))
    rows.write.parquet(f"{root}/in")
    ingest(spark, f"{root}/in", f"{root}/store", f"{root}/state").awaitTermination()
    stored = spark.read.schema(STORED).parquet(f"{root}/store")
    return stored.groupBy("technology", "version").agg(F.count("*").alias("pages"), F.sum(F.length("content")).alias("characters"))


#: A second arrival brings every third capture again, a day later and under a new id.
ARRIVALS = r"""arrivals AS (SELECT id, 'https://' || regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '/docs/v' || (id % 5) || '/p' || id AS url, status, content_type, '2026-08-20' AS day FROM captures),
both_ AS (SELECT * FROM arrivals UNION ALL SELECT id + 1000000000, url, status, content_type, '2026-08-21' FROM arrivals WHERE id % 3 = 0),
newest AS (SELECT url, max(struct_pack(day := day, came := id)) AS last FROM both_ WHERE status < 400 AND (content_type IN ('', 'application/xml', 'text/html')) GROUP BY url),
named AS (SELECT split_part(regexp_replace(regexp_replace(regexp_extract(url, '^https://([^/]*)', 1), '^www\.', ''), '^docs\.', ''), '.', 1) AS technology, regexp_extract(url, '/docs/(v\d+)/', 1) AS version, url, last.day AS day, last.came AS came FROM newest)"""


@query("st1_ingested_pages", f", {ARRIVALS} SELECT technology, version, row_number() OVER (PARTITION BY technology, version ORDER BY came) AS ordinal, url, day, came FROM named", CAPTURES)
def st1_pages(spark, d):
    """Two arrivals, each ingested as it comes: the newest capture of each URL, numbered anew in its version."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    moved = F.concat(F.lit("https://"), host, F.lit("/docs/v"), (F.col("id") % 5).cast("string"), F.lit("/p"), F.col("id").cast("string"))
    rows = captures(spark, d).withColumn("url", moved).withColumn("harvested_at", F.lit("2026-08-20").cast("timestamp"))
    again = rows.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000_000).withColumn("harvested_at", F.lit("2026-08-21").cast("timestamp"))
    for arrival in (rows, again):
        arrival.write.mode("append").parquet(f"{root}/in")
        ingest(spark, f"{root}/in", f"{root}/store", f"{root}/state").awaitTermination()
    stored = spark.read.schema(STORED).parquet(f"{root}/store")
    return stored.select("technology", "version", "ordinal", "url", F.date_format("harvested_at", "yyyy-MM-dd").alias("day"), "came")
