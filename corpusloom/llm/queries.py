"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat_format, exact_dedup, fill_in_middle, lang_id, line_dedup, media, near_dup, packing, quality, secret_scan, topk_search, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def secrets(docs: DataFrame) -> DataFrame:
    """The scan of ``documents``: a document's owner is its source; its documents in one language are a repository."""
    owned = docs.select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repository"))
    return secret_scan.scan(owned)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secrets(_table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_removed")
    return found.select("doc_id", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS nth
  FROM windows WHERE line3 IS NOT NULL AND NOT (trim(line) = '' AND trim(line2) = '' AND trim(line3) = '')),
covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) AS v(k) WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS text, count(c.pos) AS n_removed
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def transcripts(conversations: DataFrame) -> DataFrame:
    """The conversations as raw transcripts: ``raw`` names the speaker in the manner of the conversation's format.

    Formats go by a hash of the conversation; one turn in five has no marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    human = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise("System")
    name = F.coalesce(F.col("role"), F.lit("user"))
    marked = (
        F.when(style == 0, F.concat(F.initcap(name), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), F.initcap(name), F.lit(":\n")))
        .when(style == 2, F.concat(human, F.lit(": ")))
        .otherwise(F.concat(F.lit("<|"), name, F.lit("|>\n")))
    )
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    return conversations.withColumn("raw", F.concat(F.when(bare, "").otherwise(marked), F.coalesce("text", F.lit(""))))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_format.parse(transcripts(_table(spark, sf_dir, "conversations")), text_col="raw")
    return found.select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), F.col("role").alias("role_found"), F.size("turns").cast("long").alias("n_turns"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.round("quality", 6).alias("quality"), F.round("weak", 6).alias("weak_label"), "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify_with_training(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(_table(spark, sf_dir, "documents"), keep=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk_search.top_k(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


OP8_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM (SELECT * FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    found = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=False)
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=False)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.classes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha256").alias("text_sha256"))


OP11_SQL = r"""
WITH normal AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
ranked AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id
  FROM normal WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    # exact in the operator; beyond a long null
    deviation = F.expr("try_cast(deviation as long)").alias("deviation")
    return found.select(F.col("id").alias("vec_id"), "component", "n", deviation, "whitened", "explained", "identity_error")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"), keep=False)
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
pieces AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_line_dedup, op3_chat_format, op4_quality_classifier, op5_language_id, op6_hyperminhash, op7_media_columns, op8_topk_search, op9_packing, op10_bpe_codec, op11_exact_dedup, op12_embedding_whitening, op13_fill_in_middle, pipeline)
}
ORACLES: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op8_topk_search": OP8_SQL, "op11_exact_dedup": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
