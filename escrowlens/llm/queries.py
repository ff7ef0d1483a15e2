"""The registered queries of the training-text operators and their DuckDB SQL.

Each query applies one operator, with production parameters, to its whole
table and derives the digest columns from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escrowlens.llm import (audit, bpe, exact, langid, lines, minhash, mixing, multi_index,
                            negatives, quality, sketch, substring, warc)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (similarity 0.75 or more)."""
    return minhash.near_dedup(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text, and the round trip back to bytes."""
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks removed from all documents."""
    return (lines.line_dedup(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256")))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1, repeating; at most three times each."""
    return (mixing.mix_sources(_table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 3.0::DOUBLE AS cap FROM s),
levels AS (
  SELECT (SELECT sum(source_size) FROM w)::DOUBLE AS total, a.source,
         coalesce((SELECT sum(b.cap) FROM w b WHERE (b.cap / b.w, b.place) < (a.cap / a.w, a.place)), 0.0) AS done,
         (SELECT sum(b.w) FROM w b WHERE (b.cap / b.w, b.place) >= (a.cap / a.w, a.place)) AS rest
  FROM w a),
goal AS (
  SELECT source, source_size, least(cap, w * (SELECT max((total - done) / rest) FROM levels)) AS target FROM w),
cut AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goal),
peers AS (
  SELECT d.source, d.h, sum(d.size) AS words,
         sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM d GROUP BY d.source, d.h),
once AS (
  SELECT p.source, p.h, (p.upto <= c.target - c.copies * c.source_size
           OR (p.upto - p.words <= c.target - c.copies * c.source_size
               AND p.upto - (c.target - c.copies * c.source_size)
                   < (c.target - c.copies * c.source_size) - (p.upto - p.words))) AS more
  FROM peers p JOIN cut c ON p.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, d.size, c.source_size, c.target,
       (d.size * CASE WHEN c.source_size = 0 THEN 0
                      ELSE least(3, c.copies + CASE WHEN o.more THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source
JOIN once o ON o.source IS NOT DISTINCT FROM d.source AND o.h = d.h
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of every document; the digest column covers all texts.

    As in the SQL, ``kept`` is null where ``doc_id`` is null.
    """
    return (exact.exact_dedup(_table(spark, sf_dir, "documents"), digest="text_sha256")
            .withColumn("kept", F.col("doc_id") == F.col("keep_id")))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index."""
    index, folder = warc.write_archives(_table(spark, sf_dir, "pages"))
    return (warc.read_records(index, folder, with_payload=False)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS last,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT) >> (15 - 5 * (k % 4))) & 31)::INT, 1)
           FOR k IN range(0, 32)], '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learned from two thirds of the ids."""
    docs = _table(spark, sf_dir, "documents")
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3) == 1
    model = langid.fit(docs.filter(~held).select("text", "lang"))
    return (langid.predict(docs, model)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score",
                    F.size("spans").alias("n_spans")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under repeated 35-word windows removed from all documents."""
    return (substring.remove_repeats(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM twice),
kept AS (
  SELECT w.doc_id, string_agg(w.words[u.k], ' ' ORDER BY u.k) AS kept, count(*) AS n
  FROM w, unnest(range(1, len(w.words) + 1)) AS u(k)
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = w.doc_id AND c.k = u.k) GROUP BY 1)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighted against the good ones and drawn by Gumbel top-k."""
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with three likenesses."""
    rows = sketch.with_next(_table(spark, sf_dir, "documents"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"),
                      F.substring("next_text", F.lit(1), third))
    rows = sketch.add_sketch(rows.withColumn("_edited", edited), "_edited", "_edited_sketch")
    own, changed = F.col("sketch"), F.col("_edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        sketch.fingerprint_text(own).alias("fingerprint"),
        sketch.fingerprint_text(changed).alias("edited_fingerprint"),
        sketch.likeness(own, changed).alias("near_edited"),
        sketch.likeness(own, F.col("next_sketch")).alias("near_next"),
        sketch.containment(own, changed).alias("contained_in_edited"))


def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each hundredth vector, through an index over all vectors."""
    return multi_index.nearest_neighbours(_table(spark, sf_dir, "embeddings"),
                                          F.col("vec_id") % 100 == 0, k=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each hundredth vector, exact, from blocks chosen by zone maps."""
    rows = negatives.quantised(_table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id))::INT AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 10
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, per source."""
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
m AS (
  SELECT part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
       + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
       + CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 2 * length(body) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END) AS mask,
       doc_id IN (FROM good) AS good, doc_id IN (FROM toxic) AS toxic FROM t),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
  FROM m GROUP BY part, mask),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS ls, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT array_to_string(ls, '') AS filter_order, k AS step, bits[k] AS bit,
         coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before
  FROM orders, unnest(range(1, 6)) AS u(k)),
pairs AS (SELECT DISTINCT bit, before FROM steps),
sums AS (
  SELECT part, bit, before,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(x) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, pairs GROUP BY part, bit, before)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM steps JOIN sums USING (bit, before)
"""


QUERIES = {f.__name__: f for f in (
    op1_minhash_dedup, op2_byte_bpe, op3_line_dedup, op4_source_mix, op5_exact_dedup, op6_warc_index,
    op7_language_id, op8_substring_dedup, op9_importance_resampling, op10_scaled_sketch,
    op11_inverted_multi_index, op12_hard_negatives, op13_filter_audit)}
SQL = {"op4_source_mix": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op6_warc_index": OP6_SQL,
       "op8_substring_dedup": OP8_SQL, "op12_hard_negatives": OP12_SQL,
       "op13_filter_audit": OP13_SQL}
