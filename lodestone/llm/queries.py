"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, fingerprint, mixing, nearest, quality, secrets, simhash_dedup, substring_dedup, token_counts, warc
from .common import settle, table


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def hex64(fp: str) -> F.Column:
    """A 64-bit fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("_base", lambda b: b["kind"] == i)).cast("long")
    kinds = [count(i).alias(f"n_{k}") for i, k in enumerate(secrets.PATTERNS)]
    return found.select("doc_id", *kinds, F.sha2(secrets.written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = settle(fingerprint.edited_pairs(table(spark, sf_dir, "documents"), keep_text=False))
    near = fingerprint.within(pairs, pairs.filter(F.col("id") % 100 == 0)).filter("distance > 0").groupBy("query_fp").agg(F.count("*").alias("n_near"))
    out = pairs.join(near, pairs["fp"] == near["query_fp"], "left")
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", hex64("fp").alias("fingerprint"), hex64("edited_fp").alias("edited_fingerprint"),
        fingerprint.likeness("fp", "edited_fp").alias("near_edited"), fingerprint.likeness("fp", "next_fp").alias("near_next"),
        F.when(F.col("id") % 100 == 0, F.coalesce("n_near", F.lit(0))).alias("n_near"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(mixing.sized(table(spark, sf_dir, "documents"), ("doc_id",)))
    return mixing.mix(rows).select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages"))
    field = lambda name: F.try_element_at("metadata.fields", F.lit(name)).cast("long")
    return captures.select(field("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), field("refers-to-page").alias("refers_to"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_dedup.simhash_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), hex64("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_nearest, op3_secrets, op4_fingerprints, op5_token_counts, op6_mixing, op7_bpe_codec, op8_warc, op9_simhash_dedup, op10_quality)
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS words FROM documents),
starts AS (SELECT rid, doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d WHERE doc_id IS NOT NULL),
windows AS (SELECT rid, doc_id, pos, array_to_string(list_slice(words, pos, pos + 12), ' ') AS body FROM starts),
firsts AS (SELECT body, min(doc_id) AS first_id FROM windows GROUP BY body),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + 13)) AS pos FROM windows JOIN firsts USING (body) WHERE first_id < doc_id),
marked AS (SELECT rid, list(pos) AS gone FROM gone GROUP BY rid),
kept AS (SELECT doc_id, words, coalesce(len(gone), 0) AS n_removed,
                CASE WHEN gone IS NULL THEN words ELSE [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(gone, i)] END AS kept
         FROM d LEFT JOIN marked USING (rid))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM kept""",
    "op6_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM s),
weighed AS (SELECT *, [3, 1, 2][(n - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS most FROM numbered),
leveled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
                      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
            FROM weighed WINDOW before AS (ORDER BY most / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT source, source_size, least(most, max(level) OVER () * w) AS target,
                ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS drawn FROM leveled),
salted AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '')) AS hash, greatest(length(bin(size)) - 3, 0) AS low FROM d),
strata AS (SELECT *, (size >> low) << low AS class, ('0x' || substr(hash, 1, 8))::BIGINT % greatest(32, -(-(SELECT count(*) FROM d) // 1000000)) AS salt FROM salted),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, hash) AS n FROM strata),
stepped AS (SELECT p.doc_id, p.size, q.source_size, q.target, q.drawn, p.n, CASE WHEN q.source_size > 0 THEN q.target / q.source_size ELSE 0 END AS step
            FROM placed p JOIN plan q ON p.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST((floor(drawn + n * step) - floor(drawn + (n - 1) * step)) * size AS BIGINT) AS taken FROM stepped""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS h FROM p),
coded AS (SELECT page_id, payload_bytes,
                 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS INTEGER) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest
          FROM hashed),
answered AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response_id FROM coded)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM response_id THEN NULL ELSE response_id END AS refers_to
FROM answered""",
}
