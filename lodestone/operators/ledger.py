"""The citation ledger: checks before recording, evidence ids, and the audit for staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import hexes

#: Verdicts, and origins of a field that do not vouch for it.
VERDICTS = ("SUPPORTED", "PARTIAL", "UNSUPPORTED", "UNCERTAIN")
WEAK = ("", "LEARNED_FILENAME_PATTERN", "FILENAME_FALLBACK", "MARKDOWN_HEADING", "PDF_DOCUMENT_METADATA", "MARKDOWN_FRONTMATTER")
SHOWN = ("title", "authors", "year", "journal")


def preflight(works: DataFrame) -> DataFrame:
    """(paper_id, identity_accepted, missing, weak, complete, true) of each work; works: identity_status, identity_conflict, SHOWN, metadata_provenance."""
    accepted = F.col("identity_status").isin("DOI", "MANIFEST_ID", "METADATA_KEY") & (F.coalesce("identity_conflict", F.lit("")) == "")
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in SHOWN)))
    origin = lambda c: F.coalesce(F.try_element_at("metadata_provenance", F.lit(c)), F.lit(""))
    weak = F.array_compact(F.array(*(F.when(origin(c).isin(*WEAK), c) for c in SHOWN)))
    out = works.select("paper_id", accepted.alias("identity_accepted"), F.array_join(missing, ",").alias("missing"), F.array_join(weak, ",").alias("weak"))
    return out.withColumn("complete", F.col("missing") == "").withColumn("true", (F.col("missing") == "") & (F.col("weak") == ""))


def evidence_id(claim: Column, work: Column, locator: Column) -> Column:
    return F.concat(F.lit("ev:"), hexes(F.concat_ws("|", claim, work, locator), 32))


def audit(ledger: DataFrame, passages: DataFrame, works: DataFrame) -> DataFrame:
    """(evidence_id, status): CURRENT, or what went stale.

    passages: locator_id, source_hash, paper_id, artifact_id, as they are now; works: paper_id, bibliography_fingerprint.
    The source is stale if the locator is gone, its content changed, or it is now bound to another work or artifact; the
    bibliography if the work is gone, nothing was recorded of it, or it changed.
    """
    p = passages.select("locator_id", F.struct(F.col("source_hash"), F.col("paper_id"), F.col("artifact_id")).alias("_now")).dropDuplicates(["locator_id"])
    w = works.select(F.col("paper_id"), F.col("bibliography_fingerprint").alias("_print"))
    same = F.col("_now.source_hash").eqNullSafe(F.col("source_hash")) & F.col("_now.paper_id").eqNullSafe(F.col("paper_id")) & F.col("_now.artifact_id").eqNullSafe(F.col("artifact_id"))
    kept = (F.coalesce("bibliography_fingerprint", F.lit("")) != "") & F.col("_print").eqNullSafe(F.col("bibliography_fingerprint"))
    status = F.when(F.col("_now").isNull() | ~same, "SOURCE_STALE").when(~kept, "BIBLIOGRAPHY_STALE").otherwise("CURRENT")
    return ledger.join(p, "locator_id", "left").join(w, "paper_id", "left").select("evidence_id", status.alias("status"))


def stale_since(saved: dict[str, str], now: dict[str, str]) -> list[str]:
    """Of the fingerprints saved with a run those that have changed: COVERAGE (which works are searched), RANKING (what their index holds), SOURCE."""
    return [f"{k.upper()}_STALE" for k in ("coverage", "ranking", "source") if saved.get(f"{k}_fingerprint") != now.get(f"{k}_fingerprint")]
