"""The subpackage's queries for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motifloom.llm.durable import durable
    from motifloom.llm.media import media_features, media_from_texts

    stored = media_from_texts(_table(spark, sf_dir, "documents"), ["doc_id"])
    told = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    # The tiles are written as NPY bytes; their digest is that of what is read back.
    return durable(media_features(stored, "media", [*told, "media_format"]), "media-tiles").select(*told, "feature", "media_format", F.size("tiles").alias("n_tiles"), F.sha2(F.array_join(F.transform("tiles", lambda x: F.sha2(x, 256)), ","), 256).alias("tiles_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motifloom.llm.pii import sanitise, span_digest

    return span_digest(sanitise(_table(spark, sf_dir, "documents"), rewrite=False))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motifloom.llm.sharding import shard_by_bytes

    return shard_by_bytes(_table(spark, sf_dir, "documents"), 24).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motifloom.llm.vectors import link_vectors

    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motifloom.llm.shingle_join import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motifloom.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"])


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motifloom.llm.licenses import scan_licenses

    found = scan_licenses(_table(spark, sf_dir, "documents"), ["doc_id"])
    told = F.transform("matches", lambda x: F.concat_ws(":", x["license"], x["shared"].cast("string"), x["first"].cast("string"), x["last"].cast("string")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(told, ",").alias("licenses"), F.array_max(F.transform("matches", lambda x: x["score"])).alias("best_score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motifloom.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from motifloom.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motifloom.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_REACH = """, reach AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS MATERIALIZED (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""

#: CRC-32 of a text's UTF-8 bytes, byte by byte, with the table made from the reflected polynomial.
_CRC32 = """crc AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_concat([k::BIGINT], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(3988292384::BIGINT, x >> 1) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k))),
bytes AS (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS MATERIALIZED (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8))) AS crc FROM bytes, crc)"""

_SHARDS = f"""WITH {_CRC32},
run AS (SELECT doc_id, size, crc, sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sums),
cut AS (SELECT *, CAST((2 * upto - size) * 24 // (2 * total) AS INTEGER) AS shard FROM run)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut"""

_VECTORS = f"""WITH RECURSIVE fine AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93)
{_REACH.format(nodes="fine")}
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE links.a = v.vec_id) AS BIGINT) AS n_links, coalesce(l.component, v.vec_id) AS component_id,
  coalesce(v.vec_id = coalesce(l.component, v.vec_id), false) AS kept FROM embeddings v LEFT JOIN least l ON l.id = v.vec_id"""

_SHINGLES = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT id, len(s) AS n FROM sets), g AS MATERIALIZED (SELECT id, hash(unnest(s)) AS h FROM sets),
common AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.h = y.h AND x.id <> y.id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 75 * (x.n + y.n - c))
{_REACH.format(nodes="n")}
SELECT n.id AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, least.component AS component_id FROM n JOIN least ON least.id = n.id"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB. The others depend on a fitted model, a tokenizer, pixels or a hash; tests hold them against brute force."""
    from motifloom.llm import licenses

    return {"op3_shards": _SHARDS, "op4_vectors": _VECTORS, "op5_shingle_join": _SHINGLES, "op7_licenses": licenses.oracle_sql()}
