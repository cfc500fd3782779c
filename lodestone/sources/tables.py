"""The driver's tables as a corpus: each document an artifact, each pair of documents a work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: MB of a table's files for each task that cuts or scans its texts.
TASK_MB = 4


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, rows: DataFrame) -> DataFrame:
    """`rows` of a table, dealt by `key`: however large its files and row groups are, a task gets about TASK_MB of them."""
    held = int(str(table(spark, sf_dir, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(-(-held // (TASK_MB << 20)), spark.sparkContext.defaultParallelism), key)


#: Up to the eighth word; the rest of a text is not read for its title.
FIRST_WORDS = r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){0,8}+"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = table(spark, sf_dir, "documents").drop("n_chars"), F.col("doc_id")
    process, other, odd = F.col("source").isin("src18", "src19"), F.col("source") == "src17", n % 2 == 1
    four = lambda a, b, c, e: F.when(process, a).when(other, b).when(odd, c).otherwise(e)
    path = F.concat(F.lit("documents/"), n)
    year = (2000 + n % 25).cast("string")
    return d.select(
        "doc_id", "text", "lang", "source",
        F.sha1(path.cast("binary")).alias("artifact_id"),
        F.concat(F.lit("documents/"), "source", F.lit("/"), n, F.lit(".txt")).alias("source_rel"),
        F.concat(F.lit("work:"), n - n % 2).alias("paper_id"),
        F.when(process, "PROCESS").otherwise("PAPER").alias("root_role"),
        four("PROCESS_EVIDENCE", "OTHER", "ONLINE_APPENDIX", "MAIN_ARTICLE").alias("role"),
        four("PROCESS_FILE", "REPLICATION_PACKAGE", "APPENDIX_FILE", "PRIMARY_PDF").alias("artifact_kind"),
        F.when(odd, "PREPRINT").otherwise("PUBLISHED").alias("artifact_version"),
        F.array_join(F.regexp_extract_all(F.regexp_extract("text", FIRST_WORDS, 0), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ").alias("title"),
        F.concat(F.lit("Author "), n % 50).alias("authors"),
        year.alias("year"),
        F.when(F.col("lang") == "en", "Journal A").when(F.col("lang") == "de", "Journal B").otherwise("Journal C").alias("journal"),
        F.when(n % 3 == 0, F.concat(F.lit("10.1287/test."), year, F.lit("."), n)).otherwise("").alias("doi"),
        F.lit("").alias("keywords"),
        F.when(n % 4 == 0, "MANIFEST").otherwise("FILENAME_FALLBACK").alias("metadata_source"),
        F.when(n % 3 == 0, "DOI").otherwise("METADATA_KEY").alias("identity_status"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
    ).withColumn("metadata_provenance", F.create_map(F.lit("title"), F.lit("SOURCE_FRONT_MATTER"), F.lit("authors"), F.when(odd, "PDF_DOCUMENT_METADATA").otherwise("FILENAME_FALLBACK"), F.lit("year"), F.lit("MARKDOWN_FRONTMATTER"), F.lit("journal"), F.lit("MANIFEST"), F.lit("doi"), F.lit("SOURCE_FRONT_MATTER")))


#: The same view for DuckDB.
ARTIFACTS_SQL = r"""
art AS (SELECT doc_id, text, lang, source, sha1('documents/' || doc_id) AS artifact_id,
  'documents/' || source || '/' || doc_id || '.txt' AS source_rel, 'work:' || (doc_id - doc_id % 2) AS paper_id,
  CASE WHEN source IN ('src18', 'src19') THEN 'PROCESS' ELSE 'PAPER' END AS root_role,
  CASE WHEN source IN ('src18', 'src19') THEN 'PROCESS_EVIDENCE' WHEN source = 'src17' THEN 'OTHER' WHEN doc_id % 2 = 1 THEN 'ONLINE_APPENDIX' ELSE 'MAIN_ARTICLE' END AS role,
  CASE WHEN source IN ('src18', 'src19') THEN 'PROCESS_FILE' WHEN source = 'src17' THEN 'REPLICATION_PACKAGE' WHEN doc_id % 2 = 1 THEN 'APPENDIX_FILE' ELSE 'PRIMARY_PDF' END AS artifact_kind,
  CASE WHEN doc_id % 2 = 1 THEN 'PREPRINT' ELSE 'PUBLISHED' END AS artifact_version,
  array_to_string(list_slice(regexp_extract_all(text, '[\p{L}\p{N}]+'), 1, 8), ' ') AS title,
  'Author ' || doc_id % 50 AS authors, CAST(2000 + doc_id % 25 AS VARCHAR) AS year,
  CASE lang WHEN 'en' THEN 'Journal A' WHEN 'de' THEN 'Journal B' ELSE 'Journal C' END AS journal,
  CASE WHEN doc_id % 3 = 0 THEN '10.1287/test.' || (2000 + doc_id % 25) || '.' || doc_id ELSE '' END AS doi,
  CASE WHEN doc_id % 3 = 0 THEN 'DOI' ELSE 'METADATA_KEY' END AS identity_status, sha256(text) AS content_hash FROM documents)"""
