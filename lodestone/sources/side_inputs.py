"""Manifests, corpus profiles and benchmarks: small JSON files beside the corpus."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import ROLES

MANIFEST = "path string, paper_id string, doi string, title string, authors string, year string, journal string, abstract string, keywords string, role string, artifact_kind string, identity_status string"
PROFILE = "root string, code string, role string, version string, access string, artifact_kind string, basis string"
BENCHMARK = "query_id string, queries array<string>, relevant_paper_ids array<string>, hard_negative_paper_ids array<string>, match string, case_type string"


def _text(spark: SparkSession, path: str) -> str:
    """A small file, from wherever Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0].removeprefix("\ufeff")


def _records(spark: SparkSession, path: str, key: str) -> list[dict]:
    """The objects of a JSON array, of an object that holds one, or of JSON lines."""
    text = _text(spark, path)
    if os.path.splitext(path)[1].lower() in (".jsonl", ".ndjson"):
        return [json.loads(x) for x in text.splitlines() if x.strip()]
    found = json.loads(text)
    return found[key] if isinstance(found, dict) else found


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    flat = lambda n, v: "; ".join(map(str, v)) if isinstance(v, list) and n in ("authors", "keywords") else v if v is None or isinstance(v, list) else str(v)
    return spark.createDataFrame([tuple(flat(n, r.get(n)) for n in names) for r in rows], schema)


def manifest(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Each record names exactly one file, no file twice."""
    rows = _records(spark, path, "papers")
    paths = [r.get("path", "") for r in rows]
    if len(set(paths)) < len(paths) or "" in paths:
        raise ValueError("manifest records need distinct paths")
    if wrong := {str(r["role"]).upper() for r in rows if r.get("role")} - set(ROLES):
        raise ValueError(f"unknown roles in the manifest: {sorted(wrong)}")
    out = _frame(spark, rows, MANIFEST)
    if files is not None:
        named = files.select("source_path", F.explode(F.array_distinct(F.array("source_path", "source_rel"))).alias("path"))
        met = out.join(named, "path", "left").groupBy("path").agg(F.count("source_path").alias("n"), F.first("source_path").alias("file"))
        if lost := met.filter("n <> 1").take(5):
            raise ValueError(f"manifest paths that do not name one file: {[r['path'] for r in lost]}")
        if twice := met.groupBy("file").count().filter("count > 1").take(5):
            raise ValueError(f"files that two manifest records name: {[r['file'] for r in twice]}")
    return out


def _corpora(spark: SparkSession, path: str) -> list[dict]:
    spec = json.loads(_text(spark, path))
    if spec.get("profile_version") != 1:
        raise ValueError("unknown profile version")
    return spec.get("corpora", [])


def profile(spark: SparkSession, path: str, roots: list[str]) -> DataFrame:
    """The rules of a corpus profile for these roots, by artifact code. A rule that no user has confirmed is an error, not a rule."""
    rows = []
    for corpus in _corpora(spark, path):
        for code, rule in corpus.get("artifact_codes", {}).items() if corpus.get("root") in roots else ():
            if rule.get("role") not in ROLES:
                raise ValueError(f"unknown role in the profile: {rule.get('role')}")
            if rule.get("basis") != "USER_CONFIRMED":
                raise ValueError(f"the rule for {code} is not confirmed")
            rows.append({"root": corpus["root"], "code": code.upper()} | rule)
    return _frame(spark, rows, PROFILE)


def known_layout(spark: SparkSession, path: str | None) -> list[tuple[str, str, str]]:
    """(root, kind, value) of what a profile has seen or ruled: codes with rules, codes known to have none, and the observed structure."""
    out = []
    for corpus in _corpora(spark, path) if path else ():
        seen = corpus.get("observed_structure", {})
        out += [(corpus["root"], "code", c.upper()) for c in [*corpus.get("artifact_codes", {}), *corpus.get("known_unmapped_codes", [])]]
        out += [(corpus["root"], kind, v) for kind, name in (("extension", "extensions"), ("directory", "top_directories"), ("prefix", "unmatched_prefixes")) for v in seen.get(name, [])]
    return out


def discover_profile(roots: list[str]) -> str | None:
    """A profile at its usual place: in the folder `.lodestone` beside a single local root, or in the common parent of several or above it; never within a root."""
    real = [os.path.realpath(r) for r in roots]
    if not real:
        return None
    common = os.path.commonpath(real)
    for place in (common, os.path.dirname(common)):
        found = os.path.join(place, ".lodestone", "corpus_profile.json")
        if os.path.isfile(found) and not any(os.path.commonpath([found, r]) == r for r in real):
            return found
    return None


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    rows = [r | {"queries": r.get("queries") or [r["query"]]} if r.get("queries") or r.get("query") else r for r in _records(spark, path, "rows")]
    for r in rows:
        if not (r.get("query_id") and r.get("queries") and r.get("relevant_paper_ids")):
            raise ValueError("a benchmark row needs query_id, query or queries, relevant_paper_ids")
    return _frame(spark, rows, BENCHMARK)
