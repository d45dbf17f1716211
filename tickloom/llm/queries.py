"""Queries of the operators over their whole tables, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import source_divergence
from .embedding_dedup import near_vectors
from .langid import detect_language, train_languages
from .line_dedup import dedup_passages
from .merkle import fold_proofs, merkle_manifest, record_digest
from .mixing import mix
from .packing import pack
from .quality import score_quality
from .shared import cut, drop_cuts, drop_path, shared_path
from .simhash import near_duplicates
from .token_count import count_tokens
from .token_records import record_starts, write_records
from .toxicity import labelled_sample, score_toxicity, train_toxicity
from .warc import read_archives, write_archives


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs, removed_col="n_removed_lines")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    sample, prior = labelled_sample(docs, labels.where(~held_out))
    model = train_toxicity(sample, prior=prior)
    found = score_toxicity(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train_languages(docs.where(~held_out), vocabulary("piece_bpe_32k.model"))
    return detect_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), root).agg(F.sum("records")).first()
    records = cut(read_archives(spark, root, with_payload=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    drop_path(spark, root)
    return records


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "tokens")
    write_records(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), root, end_id=2).agg(F.sum("records")).first()
    found = cut(record_starts(spark, root).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", "offset"), "records")
    drop_path(spark, root)
    return found


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, tampered = record_digest(*values, F.col("text")), record_digest(*values, F.translate("text", upper, upper.lower()))
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(F.col("doc_id").alias("id"), "source", leaf.alias("leaf"), F.when(changed, tampered).alias("tampered"))
    rows, held = merkle_manifest(leaves)
    found = fold_proofs(rows.withColumn("tampered", F.coalesce("tampered", "leaf")), "tampered")
    text = lambda c: F.lower(F.hex(c))
    found = found.select(
        F.col("id").alias("doc_id"), *(text(c).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256")), text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
    found = cut(found, "manifest")
    drop_cuts(*held)
    return found


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_line_dedup, op3_toxicity, op4_embedding_dedup, op5_simhash, op6_mixing, op7_langid, op8_warc, op9_token_count, op10_quality, op11_token_records, op12_merkle, op13_divergence)
}

_MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42#' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS spot
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source),
weighted AS (SELECT *, [3, 1, 2][((rk - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
filled AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0) AS rest_words, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS rest_weight,
         row_number() OVER (ORDER BY cap / weight, rk) AS place
  FROM weighted WINDOW f AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT min(place) AS place FROM filled WHERE NOT (weight * rest_words >= cap * rest_weight)),
level AS (SELECT rest_words / rest_weight AS level FROM filled, stop WHERE filled.place = stop.place),
targets AS (
  SELECT source, source_size, CASE WHEN filled.place >= stop.place THEN weight * (SELECT level FROM level) ELSE cap END AS target FROM filled, stop),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.spot, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM placed
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS least FROM q)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > least THEN least END AS refers_to
FROM f
"""

_VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts ON vec_id = parts.a LEFT JOIN degree ON vec_id = degree.a
"""

_MERKLE_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, lang, n_chars, text,
  coalesce(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]),
    lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0::BIGINT for k in range(8)]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 0) AS crc
  FROM documents),
l AS (SELECT doc_id, source, crc,
  list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')],
    lambda v: coalesce(strlen(v) || ':' || v, '-')) AS f FROM d),
leaves AS (SELECT doc_id, source, sha256(array_to_string(f[1:5], '')) AS leaf,
  sha256(array_to_string(CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295::BIGINT) % 5 = 0 THEN f[1:4] || f[6:6] ELSE f[1:5] END, '')) AS seen FROM l),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
m AS (SELECT max(tree) + 1 AS m FROM placed),
own AS (
  SELECT tree, 0 AS level, idx, n AS wide, leaf AS digest, NULL::VARCHAR[] AS children FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 16, (any_value(wide) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)), list(digest ORDER BY idx)
  FROM own WHERE wide > 1 GROUP BY tree, level, idx // 16),
subroots AS (SELECT tree, digest AS subroot FROM own WHERE wide = 1),
top AS (
  SELECT 0 AS level, tree AS idx, m AS wide, subroot AS digest, NULL::VARCHAR[] AS children FROM subroots, m
  UNION ALL
  SELECT level + 1, idx // 16, (any_value(wide) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)), list(digest ORDER BY idx)
  FROM top WHERE wide > 1 GROUP BY level, idx // 16),
nodes AS (SELECT tree, level, idx, children FROM own WHERE level > 0 UNION ALL SELECT -1, level, idx, children FROM top WHERE level > 0),
steps AS (
  SELECT doc_id, leaf, tree AS own_tree, tree, 0 AS level, idx, n AS wide, seen AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT s.doc_id, s.leaf, s.own_tree, CASE WHEN s.wide > 1 THEN s.tree ELSE -1 END, CASE WHEN s.wide > 1 THEN s.level + 1 ELSE 0 END,
         CASE WHEN s.wide > 1 THEN s.idx // 16 ELSE s.own_tree END, CASE WHEN s.wide > 1 THEN (s.wide + 15) // 16 ELSE m END,
         CASE WHEN s.wide > 1 THEN sha256(array_to_string(children[1:(s.idx % 16)] || [s.folded] || children[(s.idx % 16 + 2):], '')) ELSE s.folded END,
         s.proof || CASE WHEN s.wide > 1 THEN array_to_string(children[1:(s.idx % 16)] || children[(s.idx % 16 + 2):], '') ELSE '' END
  FROM steps s CROSS JOIN m LEFT JOIN nodes k ON s.wide > 1 AND k.tree = s.tree AND k.level = s.level + 1 AND k.idx = s.idx // 16
  WHERE s.wide > 1 OR (s.tree >= 0 AND m > 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM steps s CROSS JOIN m JOIN subroots b ON b.tree = s.own_tree CROSS JOIN (SELECT digest AS root FROM top WHERE wide = 1) r
WHERE s.wide = 1 AND (s.tree = -1 OR m = 1)
"""

_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row_no, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 3),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
sized AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0) AS total FROM groups g LEFT JOIN own o ON g.lang = o.lang AND g.source = o.source GROUP BY ALL),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (s.total + l.v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v))::HUGEINT AS q
  FROM sized s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang
  LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(a.value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL = {"op12_merkle": _MERKLE_SQL, "op13_divergence": _DIVERGENCE_SQL, "op4_embedding_dedup": _VECTOR_SQL, "op6_mixing": _MIX_SQL, "op8_warc": _WARC_SQL}
