"""A corpus of files as published snapshots, and the commands on it.

A snapshot is a folder `v=N` of Parquet tables under the corpus' place. Its `meta` table is written last: a snapshot
counts once that table is whole, so readers see all of a build or update or none of it, on any file system of Spark's.
Postings and sizes of works and passages are written sorted by term, so a query reads the row groups of its terms.

An update scans names, sizes and times, extracts only what changed, keeps the old state of a file whose extraction
failed, and carries over the vectors of works whose searched content is the same. Neither publishes a corpus without
passages. An empty file counts as absent, as Spark's reader lists none. Errors of single files are data (`error`); errors of queries and of side inputs are raised.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import identity
from .functions.text import abstract_of, front_matter, identity_text, normalize_doi, normalize_space, section_of, work_title
from .operators import evaluation, ledger, passages, retrieval, sync, works
from .plans import query as q
from .sources import files, side_inputs

SCHEMA_VERSION = 2
#: Fixed value: the journal of files that tell none.
JOURNAL = "Management Science / Marketing Science local corpus"
DOI = r"(?i)\b10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+"
WORK_WEIGHTS = {"title": 5.0, "authors": 1.5, "abstract": 3.0, "keywords": 2.0, "headings": 1.5, "journal": 0.5}
RESCUE_WEIGHTS = {"text": 1.0, "title": 1.5, "paper_id": 1.0, "role": 0.2, "journal": 0.2}
PASSAGE_WEIGHTS = {"text": 1.0, "title": 2.0, "paper_id": 1.2, "role": 0.3, "journal": 0.3}
CHANGE = ["size", "mtime", "root_role", "manifest_hash", "profile_rule_hash"]
Encoder = Callable[[list[str]], list[list[float]]]


def bind(scanned: DataFrame, manifest: DataFrame | None, rules: DataFrame | None) -> DataFrame:
    """Files with their manifest record `m` and confirmed rule `r` (null where there is none), and a hash of each."""
    spark = scanned.sparkSession
    m = manifest if manifest is not None else spark.createDataFrame([], side_inputs.MANIFEST)
    r = rules if rules is not None else spark.createDataFrame([], side_inputs.PROFILE)
    named = scanned.select("source_path", F.explode(F.array_distinct(F.array("source_path", "source_rel"))).alias("path")).join(m, "path").select("source_path", F.struct(*m.columns).alias("m"))
    stem = F.regexp_extract("source_rel", r"([^/]+?)(\.[^./]+)?$", 1)
    out = scanned.withColumn("stem", stem).withColumn("code", F.coalesce(identity.structured_name(F.col("stem"))["code"], F.lit(""))).join(named, "source_path", "left")
    own = r.select(F.col("root").alias("source_root"), "code", F.struct(*r.columns).alias("r"))
    digest = lambda c: F.coalesce(F.sha2(F.to_json(c).cast("binary"), 256), F.lit(""))
    return out.join(own, ["source_root", "code"], "left").withColumn("manifest_hash", digest("m")).withColumn("profile_rule_hash", digest("r"))


def describe(bound: DataFrame, units: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Artifacts: what is known of each file, where each field comes from, and which work it belongs to.

    Of each field the first of these that tells it counts: the manifest; what the text tells of itself; front matter, or
    the properties of a PDF (`told`); a level-one heading; a structured file name; the file's name. A DOI in the first two
    units identifies the work, unless the manifest states another one: that is a conflict.
    """
    first = F.transform(F.sort_array(F.collect_list(F.when((F.col("unit") < 2) & (F.col("part") < 2), F.struct("unit", "part", "text")))), lambda s: F.coalesce(s["text"], F.lit("")))
    heads = units.groupBy("source_path").agg(first.alias("first"), F.coalesce(F.max("error"), F.lit("")).alias("error"))
    text, md, process = F.col("content").cast("string"), F.col("extension") == ".md", F.col("root_role") == "PROCESS"
    heading = F.regexp_replace(F.regexp_extract(F.substring(text, 1, 20000), r"(?m)^#\s+(.+?)\s*$", 1), "[*_`]", "")
    a = bound.withColumns({"content_hash": F.sha2("content", 256), "front": F.when(md, front_matter(text)), "heading": F.when(md, heading)}).drop("content").join(heads, "source_path", "left")
    a = a.join(told, "source_path", "left") if told is not None else a.withColumn("properties", F.lit(None).cast("map<string,string>"))
    a = a.withColumns({"error": F.coalesce("error", F.lit("")), "name": identity.structured_name(F.col("stem")), "proc": F.when(process, identity.process_name(F.col("source_rel"), F.col("stem")))})
    a = a.withColumns({"head": normalize_space(F.array_join("first", " ")), "lines": F.array_join("first", "\n")})
    filled = lambda c: F.nullif(normalize_space(F.coalesce(c, F.lit(""))), F.lit(""))
    stated = lambda f: filled(F.col(f"m.{f}"))
    noted = lambda f: F.coalesce(filled(F.try_element_at("front", F.lit(f))), filled(F.try_element_at("properties", F.lit(f))))
    note = F.when(md, "MARKDOWN_FRONTMATTER").otherwise("PDF_DOCUMENT_METADATA")
    named = lambda f: filled(F.col(f"name.{f}"))
    plain, manifested = filled(F.regexp_replace("stem", r"(?s)__.*$", "")), F.col("m").isNotNull()
    a = a.withColumns({"cite": identity.citation_block(F.col("head")), "doi_stated": normalize_doi(F.col("m.doi")), "doi_found": normalize_doi(F.regexp_extract("head", DOI, 0))})
    found, doi_stated = F.nullif(F.col("doi_found"), F.lit("")), F.nullif(F.col("doi_stated"), F.lit(""))
    conflict = found.isNotNull() & doi_stated.isNotNull() & (found != doi_stated)
    options = {
        "title": [(stated("title"), F.lit("MANIFEST")), (noted("title"), note), (F.when(~manifested, filled(F.col("heading"))), F.lit("MARKDOWN_HEADING")), (named("title"), F.lit("LEARNED_FILENAME_PATTERN")), (plain, F.lit(""))],
        "authors": [(stated("authors"), F.lit("MANIFEST")), (filled(F.col("cite.authors")), F.lit("SOURCE_CITATION_BLOCK")), (noted("authors"), note)],
        "year": [(stated("year"), F.lit("MANIFEST")), (filled(F.col("cite.year")), F.lit("SOURCE_CITATION_BLOCK")), (noted("year"), note), (named("year"), F.lit("LEARNED_FILENAME_PATTERN")), (filled(F.col("proc.year")), F.lit(""))],
        "journal": [(stated("journal"), F.lit("MANIFEST")), (noted("journal"), note), (named("journal"), F.lit("DOI_NAMESPACE")), (filled(F.col("proc.journal")), F.lit("")), (F.lit(JOURNAL), F.lit(""))],
        "doi": [(F.when(conflict, doi_stated), F.lit("MANIFEST")), (found, F.lit("SOURCE_FRONT_MATTER")), (doi_stated, F.lit("MANIFEST")), (F.nullif(normalize_doi(noted("doi")), F.lit("")), note), (named("doi"), F.lit("LEARNED_FILENAME_PATTERN"))],
        "keywords": [(stated("keywords"), F.lit("MANIFEST")), (noted("keywords"), note)],
        "abstract": [(stated("abstract"), F.lit("MANIFEST")), (noted("abstract"), note), (F.nullif(abstract_of(F.col("lines")), F.lit("")), F.lit("SOURCE_SECTION"))],
    }
    value = lambda f, ways: F.coalesce(*(c for c, _ in ways), F.lit(""))
    origin = lambda ways: F.coalesce(*(F.when(c.isNotNull(), o) for c, o in ways), F.lit(""))
    journal = F.coalesce(F.nullif(identity.journal_of(F.coalesce(found, F.lit(""))), F.lit("")), value("journal", options["journal"]))
    a = a.withColumns({f: journal if f == "journal" else value(f, ways) for f, ways in options.items()} | {
        "metadata_provenance": F.map_filter(F.create_map(*(x for f, ways in options.items() for x in (F.lit(f), origin(ways)))), lambda k, v: v != ""),
        "identity_conflict": F.when(conflict, F.concat(F.lit("manifest_doi="), doi_stated, F.lit(" content_doi="), found)).otherwise(""),
        # What the file's name, front matter and manifest tell by themselves decides first; the text may tell more.
        "authors_first": F.coalesce(stated("authors"), filled(F.try_element_at("front", F.lit("authors"))), F.lit("")),
        "year_first": F.coalesce(stated("year"), filled(F.try_element_at("front", F.lit("year"))), named("year"), filled(F.col("proc.year")), F.lit("")),
        "doi_first": F.coalesce(doi_stated, F.nullif(normalize_doi(F.try_element_at("front", F.lit("doi"))), F.lit("")), named("doi"), F.lit("")),
        "title_first": F.coalesce(stated("title"), filled(F.try_element_at("front", F.lit("title"))), F.when(~manifested, filled(F.col("heading"))), named("title"), plain, F.lit("")),
    })
    key = F.when(~manifested & (F.col("doi_first") == "") & (F.col("authors_first") == ""), work_title(F.col("stem"))).otherwise(F.col("title_first"))
    explicit = F.when(manifested, F.when(F.upper(F.coalesce("m.identity_status", F.lit(""))) == "PROVISIONAL_FILENAME", "").otherwise(F.trim(F.coalesce("m.paper_id", F.lit(""))))).otherwise(F.coalesce("proc.manuscript", F.lit("")))
    early, early_status = identity.identity(F.col("doi_first"), explicit, key, F.col("authors_first"), F.col("year_first"))
    late, late_status = identity.identity(F.col("doi"), F.lit(""), F.col("title"), F.col("authors"), F.col("year"))
    a = a.withColumns({"early": early, "early_status": early_status, "late": late, "late_status": late_status})
    whole = (F.col("title") != "") & (F.col("authors") != "") & F.col("year").rlike("^(18|19|20)[0-9]{2}$")
    alone = md & ~manifested & (F.col("early_status") == "PROVISIONAL_FILENAME")
    again = (found.isNotNull() & ~conflict) | (F.col("early_status").isin("PROVISIONAL_FILENAME", "METADATA_KEY") & ~alone & ((F.col("doi") != "") | whole))
    a = a.withColumns({
        "identity_status": F.when(again, F.col("late_status")).when(alone, "COMPANION_UNBOUND").otherwise(F.col("early_status")),
        "paper_id": F.when(again, F.col("late")).when(alone, F.concat(F.lit("companion:"), identity.hexes(F.col("source_path"), 24))).otherwise(F.col("early")),
        "ruled": F.col("r.role"),
    })
    a = a.withColumn("role", identity.role_of(F.col("stem"), F.col("root_role"), F.col("ruled")))
    level, basis = identity.role_grounds(F.col("role"), F.col("root_role"), F.col("ruled"))
    pdf = F.col("extension") == ".pdf"
    kind = F.when(md, "STRUCTURED_COMPANION").when(process, "PROCESS_FILE").when(F.col("role") == "ONLINE_APPENDIX", F.when(pdf, "APPENDIX_PDF").otherwise("APPENDIX_FILE")).when(pdf, "PRIMARY_PDF").when(F.col("extension").isin(files.OPAQUE), "ARCHIVE_ATTACHMENT").otherwise("SOURCE_DOCUMENT")
    a = a.withColumns({"role": F.coalesce(F.upper(stated("role")), F.col("role")), "role_confidence": level, "role_basis": basis})
    a = a.withColumns({
        "artifact_kind": F.coalesce(F.upper(stated("artifact_kind")), F.nullif(F.upper(F.col("r.artifact_kind")), F.lit("")), kind),
        "artifact_version": F.coalesce(F.upper(filled(F.col("r.version"))), F.lit("UNSPECIFIED")), "access_status": F.coalesce(F.upper(filled(F.col("r.access"))), F.lit("UNSPECIFIED")),
        "metadata_source": F.when(manifested, "MANIFEST").otherwise("FILENAME_FALLBACK"), "artifact_id": F.sha1(F.col("source_path").cast("binary")),
    })
    return a.drop("m", "r", "front", "heading", "properties", "name", "proc", "first", "head", "lines", "cite", "code", "doi_stated", "doi_found", "ruled", "early", "early_status", "late", "late_status", "authors_first", "year_first", "doi_first", "title_first")


def located(units: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Passages with the id of their place; outside Markdown a passage may begin with the name of its section."""
    cut = passages.passages(units.filter("text <> ''"), keep=("source_path", "unit", "part", "page", "section"))
    cut = cut.withColumn("section", F.when(F.lower("source_path").endswith(".md"), F.col("section")).otherwise(section_of(F.col("text"), F.col("section"))))
    out = cut.join(artifacts.select("source_path", "artifact_id", "content_hash"), "source_path")
    place = [F.col(c) for c in ("artifact_id", "content_hash", "page", "section", "unit", "part", "char_start", "char_end")]
    return out.withColumn("locator_id", identity.locator(*place, F.sha2(F.col("text").cast("binary"), 256)))


def derive_works(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each work, with what its search index holds; never the text."""
    told = F.coalesce(F.try_element_at("metadata_provenance", F.lit("abstract")), F.lit(""))
    order = W.partitionBy("paper_id").orderBy(F.desc(identity.rank(told, identity.SOURCES)), F.desc(F.col("metadata_source") == "MANIFEST"), F.desc(identity.rank(F.col("artifact_version"), identity.VERSIONS)), "source_rel", "artifact_id")
    abstracts = artifacts.filter("abstract <> ''").withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("paper_id", "abstract", told.alias("_told"))
    twins = artifacts.join(works.duplicate_contents(artifacts), "content_hash").select("paper_id", F.concat(F.lit(works.DUPLICATE + " "), F.replace("papers", F.lit(","), F.lit(" vs "))).alias("note"))
    notes = artifacts.select("paper_id", F.nullif(works.without_duplicates(F.col("identity_conflict")), F.lit("")).alias("note")).unionByName(twins).groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_set("note")), "; ").alias("_notes"))
    placed = chunks.join(artifacts.filter("root_role <> 'PROCESS'").select("artifact_id", "paper_id", "source_rel"), "artifact_id").withColumn("place", F.struct("source_rel", "unit", "part", "chunk_index"))
    out = works.works(artifacts).join(abstracts, "paper_id", "left").join(notes, "paper_id", "left").join(works.headings(placed), "paper_id", "left").fillna("", ["_notes", "headings", "abstract"])
    out = out.withColumn("metadata_provenance", F.when(F.col("abstract") != "", F.map_concat("metadata_provenance", F.create_map(F.lit("abstract"), "_told"))).otherwise(F.col("metadata_provenance")))
    out = out.withColumn("identity_conflict", F.array_join(F.filter(F.array("metadata_conflict", "_notes"), lambda x: x != ""), "; ")).drop("_told", "_notes", "metadata_conflict")
    out = out.withColumn("bibliography_fingerprint", works.bibliography_print(F.col("paper_id"), F.col("identity_status"), F.col("metadata_provenance"), F.col("identity_conflict")))
    return out.withColumn("retrieval_fingerprint", F.sha2(F.concat_ws("\x1f", "retrieval_fingerprint", "abstract", "headings").cast("binary"), 256)).withColumn("normalized_title", identity_text(F.col("title")))


class Corpus:
    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place, self._checked = spark, place.rstrip("/"), set()

    # -- snapshots

    def _versions(self, tail: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/v=*{tail}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(re.findall(r"/v=(\d+)", s.getPath().toString())[-1]) for s in found or [])

    @property
    def version(self) -> int:
        if not (done := self._versions("/meta/_SUCCESS")):
            raise FileNotFoundError(f"no corpus is published at {self.place}")
        return done[-1]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the published snapshot (whose schema is checked), or of another one."""
        if version is None:
            version = self.version
            if name != "meta" and version not in self._checked:
                self.meta()
                self._checked.add(version)
        return self.spark.read.parquet(f"{self.place}/v={version}/{name}")

    def meta(self) -> dict[str, str]:
        out = {r["key"]: r["value"] for r in self.table("meta").collect()}  # a row a setting
        if out["schema_version"] != str(SCHEMA_VERSION):
            raise ValueError("the corpus has another schema; build it again")
        return out

    def _side(self, roots: dict[str, str], manifest: str | None, profile: str | None, content: bool) -> DataFrame:
        scanned = files.scan(self.spark, roots, content)
        m = side_inputs.manifest(self.spark, manifest, scanned.drop("content")) if manifest else None
        return bind(scanned, m, side_inputs.profile(self.spark, profile, list(roots)) if profile else None)

    def _publish(self, n: int, artifacts: DataFrame, chunks: DataFrame, settings: dict[str, str], vectors: DataFrame | None = None) -> None:
        save = lambda name, df: (df.write.parquet(f"{self.place}/v={n}/{name}"), self.table(name, n))[1]
        a, p = save("artifacts", artifacts), save("passages", chunks)
        if p.isEmpty():
            raise RuntimeError("no passage could be read; the published corpus stays as it is")
        w = save("works", derive_works(a, p))
        rows = p.join(a.select("artifact_id", "paper_id", "role"), "artifact_id").join(w.select("paper_id", "title", "journal"), "paper_id")
        for name, table, key, columns in (("work", w, "paper_id", list(WORK_WEIGHTS)), ("passage", rows, "locator_id", list(RESCUE_WEIGHTS))):
            save(f"{name}_postings", retrieval.Index.postings_of(table, key, columns).repartitionByRange("term").sortWithinPartitions("term"))
            count, mean = retrieval.Index.statistics(table, columns)
            settings |= {f"{name}_rows": str(count), f"{name}_mean": repr(mean)}
        save("companions", self._companions(a))
        prints = {r["kind"]: r["fingerprint"] for r in works.corpus_prints(w).collect()}  # three rows
        roots = sorted(f"{k}={v}" for k, v in settings.items() if k.startswith("root:"))
        covered = hashlib.sha256("\n".join([*roots, prints.get("coverage", "")]).encode()).hexdigest()
        settings |= {"source_fingerprint": prints.get("source", ""), "coverage_fingerprint": covered, "ranking_fingerprint": prints.get("ranking", "")}
        if vectors is not None:
            save("embeddings", vectors.join(w.select("paper_id", "retrieval_fingerprint"), ["paper_id", "retrieval_fingerprint"], "left_semi"))
        save("meta", self.spark.createDataFrame(list((settings | {"schema_version": str(SCHEMA_VERSION)}).items()), "key string, value string").coalesce(1))

    def _next(self) -> int:
        return max(self._versions(""), default=0) + 1

    def build(self, roots: dict[str, str], manifest: str | None = None, profile: str | None = None) -> None:
        """Reads everything under the roots (path: PAPER or PROCESS) and publishes it."""
        profile = profile or side_inputs.discover_profile(list(roots))
        files.check_places(roots, self.place, *(x for x in (manifest, profile) if x))
        n = self._next()
        bound = self._side(roots, manifest, profile, content=True)
        files.units(bound).write.parquet(f"{self.place}/v={n}/units")
        units = self.table("units", n)
        artifacts = describe(bound, units, files.properties(bound))
        settings = {f"root:{r}": role for r, role in roots.items()} | ({"manifest": manifest} if manifest else {}) | ({"profile": profile} if profile else {})
        self._publish(n, artifacts, located(units, artifacts), settings)

    def update(self, verify_hash: bool = False) -> dict[str, int]:
        """Publishes a snapshot of what the stored roots hold now; the number of files by change."""
        kept, n = self.meta(), self._next()
        roots = {k[5:]: v for k, v in kept.items() if k.startswith("root:")}
        old, old_passages = self.table("artifacts"), self.table("passages")
        bound = self._side(roots, kept.get("manifest"), kept.get("profile"), content=True)
        seen = bound.withColumn("content_hash", F.sha2("content", 256)) if verify_hash else bound
        sync.diff(old, seen, "source_path", CHANGE + ["content_hash"] * verify_hash).write.parquet(f"{self.place}/v={n}/changes")
        changes = self.table("changes", n)
        bound = bound.join(changes.filter("change IN ('added', 'replaced')").select("source_path"), "source_path", "left_semi")
        files.units(bound).write.parquet(f"{self.place}/v={n}/units")
        units = self.table("units", n)
        describe(bound, units, files.properties(bound)).write.parquet(f"{self.place}/v={n}/fresh")
        fresh = self.table("fresh", n)
        fresh_passages = located(units, fresh)
        empty = fresh.filter(~F.col("extension").isin(files.OPAQUE)).join(fresh_passages.select("source_path"), "source_path", "left_anti")
        failed = fresh.filter("error <> ''").select("source_path").union(empty.select("source_path")).distinct()
        artifacts = sync.apply(old, fresh, changes, "source_path", failed)
        live = artifacts.select("source_path", "content_hash", "artifact_id")
        both = old_passages.unionByName(fresh_passages).join(live, ["source_path", "content_hash", "artifact_id"], "left_semi").dropDuplicates(["locator_id"])
        self._publish(n, artifacts, both.select(old_passages.columns), {k: v for k, v in kept.items() if k != "schema_version"}, self._vectors())
        return {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}  # four rows at most

    # -- search

    def _index(self, kind: str) -> retrieval.Index:
        kept = self.meta()
        return retrieval.Index(self.table(f"{kind}_postings"), int(kept[f"{kind}_rows"]), float(kept[f"{kind}_mean"]))

    def _eligible(self, roles: list[str] | None, journal: str | None) -> DataFrame:
        if wrong := set(roles or []) - set(identity.ROLES):
            raise ValueError(f"unknown roles: {sorted(wrong)}")
        live = self.table("artifacts").filter(F.col("role").isin(roles or identity.SEARCHED_ROLES) & (F.col("artifact_kind") != "STRUCTURED_COMPANION")).select("paper_id").distinct()
        w = self.table("works")
        return (w.filter(F.col("journal").ilike(f"%{journal}%")) if journal else w).join(live, "paper_id", "left_semi").select("paper_id")

    def _vectors(self) -> DataFrame | None:
        return self.table("embeddings") if self._versions("/embeddings/_SUCCESS")[-1:] == [self.version] else None

    def _scored_passages(self, node, weights: dict[str, float], roles: list[str] | None = None) -> DataFrame:
        live = self.table("artifacts").filter(F.col("role").isin(roles or identity.SEARCHED_ROLES)).select("artifact_id", "paper_id", identity.kind_order(F.col("artifact_kind")).alias("kind_order"))
        where = self.table("passages").select("locator_id", "artifact_id").join(live, "artifact_id")
        return retrieval.bm25(self._index("passage"), node, weights).join(where, F.col("id") == F.col("locator_id")).select("paper_id", "id", "kind_order", "score")

    def search(self, queries: list[str], strategy: str = "lexical", match: str = "all", raw: bool = False, roles: list[str] | None = None, journal: str | None = None, limit: int = 10, per_work: int = 2, rescue: bool = False, encoder: Encoder | None = None, model: str = "", pool: int = 1000, **vectors: str) -> DataFrame:
        """(paper_id, rank, score, title, authors, year, journal, artifacts, passages): works by rank, each with its artifacts and up to `per_work` passages.

        One arm keeps its own order and score (BM25: smaller is better; cosine: larger); several are fused by rank.
        """
        queries = list(dict.fromkeys(x.strip() for x in queries if x.strip()))
        if strategy not in ("lexical", "semantic", "hybrid") or not queries or (raw and len(queries) > 1):
            raise ValueError("search takes queries (raw syntax: one) and the strategy lexical, semantic or hybrid")
        if any(re.search("[\u4e00-\u9fff]{2}", x) for x in queries):
            warnings.warn("a run of ideographs is one token of the index; a part of it is not found", stacklevel=2)
        nodes = [q.raw(x) if raw else q.safe(x, match) for x in queries]
        plain = [q.safe(x, match) for x in queries] if rescue else []
        fetch, eligible, arms = max(4 * limit, 50), self._eligible(roles, journal), []
        if strategy != "semantic":
            index = self._index("work")
            arms += [retrieval.ranked(retrieval.bm25(index, x, WORK_WEIGHTS).withColumnRenamed("id", "paper_id").join(eligible, "paper_id", "left_semi"), F.col("score"), F.col("paper_id"), limit=fetch) for x in nodes]
        for node in plain:
            found = self._scored_passages(node, RESCUE_WEIGHTS).join(self._eligible(None, journal), "paper_id", "left_semi")  # always of the default roles
            arms.append(retrieval.rescue(found, pool).select("paper_id", F.col("rescue_score").alias("score"), "rank"))
        if strategy != "lexical":
            arms += [self._nearest(x, encoder, model, eligible, fetch, **vectors) for x in queries]
        if len(arms) == 1:
            top = arms[0].filter(F.col("rank") <= limit).select("paper_id", "rank", "score")
        else:
            both = None
            for i, arm in enumerate(arms):
                one = arm.select(F.lit(i).alias("arm"), "paper_id", "rank")
                both = one if both is None else both.unionByName(one)
            top = retrieval.fuse(both, limit).select("paper_id", "rank", F.col("fusion_score").alias("score"))
        rows = None
        for i, node in enumerate(nodes):
            best = retrieval.best_per_work(self._scored_passages(node, PASSAGE_WEIGHTS, roles).join(top.select("paper_id"), "paper_id", "left_semi"), per_work)
            one = best.select("paper_id", F.lit(i).alias("branch"), "place", F.col("id").alias("locator"))
            rows = one if rows is None else rows.unionByName(one)
        chosen = retrieval.round_robin(rows, per_work).join(self.table("passages").withColumnRenamed("locator_id", "locator"), "locator")
        shown = chosen.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("slot", "locator", "section", "page", "text"))).alias("passages"))
        held = self.table("artifacts").join(top.select("paper_id"), "paper_id", "left_semi").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct(identity.kind_order(F.col("artifact_kind")).alias("kind_order"), "source_rel", "artifact_id", "artifact_kind", "role"))).alias("artifacts"))
        out = top.join(self.table("works").select("paper_id", "title", "authors", "year", "journal"), "paper_id").join(held, "paper_id").join(shown, "paper_id", "left")
        return out.withColumn("passages", F.coalesce("passages", F.array())).orderBy("rank")

    def run_fingerprint(self, **settings) -> str:
        """What a search's result depends on: what the index holds, and the settings of the search."""
        told = json.dumps(settings | {"ranking": self.meta()["ranking_fingerprint"]}, sort_keys=True, default=str)
        return hashlib.sha256(told.encode()).hexdigest()

    def _nearest(self, text: str, encoder: Encoder | None, model: str, eligible: DataFrame, limit: int, revision: str = "", document_prefix: str = "", query_prefix: str = "") -> DataFrame:
        if encoder is None or (vectors := self._vectors()) is None:
            raise ValueError("semantic search needs an encoder, and a corpus with its vectors")
        one = [float(x) for x in encoder([query_prefix + text])[0]]
        same = (F.col("model") == model) & (F.col("revision") == revision) & (F.col("document_prefix") == document_prefix) & (F.col("query_prefix") == query_prefix)
        rows = vectors.filter(same & (F.size("vector") == len(one))).join(self.table("works").select("paper_id", "retrieval_fingerprint"), ["paper_id", "retrieval_fingerprint"], "left_semi").join(eligible, "paper_id", "left_semi")
        return retrieval.ranked(rows.select("paper_id", retrieval.cosine(F.col("vector"), F.lit(one)).alias("score")), F.desc("score"), F.col("paper_id"), limit=limit)

    def embed(self, encoder: Encoder, model: str, revision: str, document_prefix: str = "", query_prefix: str = "", batch: int = 16) -> None:
        """Publishes a snapshot with the vectors of all works under this model and revision; those of others stay."""
        if not revision:
            raise ValueError("vectors are kept under a pinned revision of their model")
        rows = self.table("works").select("paper_id", "retrieval_fingerprint", F.concat(F.lit(document_prefix), F.concat_ws("\n", "title", "abstract", "keywords", "headings")).alias("text"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                vectors = [v for i in range(0, len(b), batch) for v in encoder(b["text"].iloc[i : i + batch].tolist())]
                yield b[["paper_id", "retrieval_fingerprint"]].assign(vector=[[float(x) for x in v] for v in vectors])

        fresh = rows.mapInPandas(run, "paper_id string, retrieval_fingerprint string, vector array<float>").withColumns({"model": F.lit(model), "revision": F.lit(revision), "document_prefix": F.lit(document_prefix), "query_prefix": F.lit(query_prefix)})
        old = self._vectors()
        vectors = fresh if old is None else old.filter((F.col("model") != model) | (F.col("revision") != revision)).unionByName(fresh)
        self._publish(self._next(), self.table("artifacts"), self.table("passages"), {k: v for k, v in self.meta().items() if k != "schema_version"}, vectors)

    def passage_search(self, paper_id: str, text: str, match: str = "all", raw: bool = False, limit: int = 10, encoder: Encoder | None = None) -> DataFrame:
        """The best passages of one work: by BM25, or by cosine of vectors made on the fly if an encoder is given."""
        own = self.table("passages").join(self.table("artifacts").filter((F.col("paper_id") == paper_id) & F.col("role").isin(identity.SEARCHED_ROLES)).select("artifact_id"), "artifact_id", "left_semi")
        if encoder is None:
            found = self._scored_passages(q.raw(text) if raw else q.safe(text, match), PASSAGE_WEIGHTS).filter(F.col("paper_id") == paper_id)
            return own.join(retrieval.ranked(found, F.col("score"), F.col("kind_order"), F.col("id"), limit=limit).select(F.col("id").alias("locator_id"), "score", "rank"), "locator_id").orderBy("rank")
        wanted = [float(x) for x in encoder([text])[0]]
        coded = F.pandas_udf(lambda s: pd.Series([[float(x) for x in v] for v in encoder(s.tolist())]), "array<double>")
        return retrieval.ranked(own.withColumn("score", retrieval.cosine(coded("text"), F.lit(wanted))), F.desc("score"), F.col("locator_id"), limit=limit)

    # -- lookups, reports

    def inspect(self, locator_id: str | None = None, paper_id: str | None = None, context: int = 1) -> DataFrame:
        """The passages around one, within its unit; or all of a work in order."""
        p = self.table("passages")
        if locator_id is not None:
            at = F.broadcast(p.filter(F.col("locator_id") == locator_id).select("artifact_id", "unit", "part", F.col("chunk_index").alias("_at")))  # one row
            return p.join(at, ["artifact_id", "unit", "part"]).filter(F.abs(F.col("chunk_index") - F.col("_at")) <= context).drop("_at").orderBy("chunk_index")
        return p.join(self.table("artifacts").filter(F.col("paper_id") == paper_id).select("artifact_id", "source_rel"), "artifact_id").orderBy("source_rel", "unit", "part", "chunk_index")

    def lookup(self, doi: str | None = None, title: str | None = None) -> DataFrame:
        """Works of exactly this DOI or title, both normalized."""
        if (doi is None) == (title is None):
            raise ValueError("lookup takes a DOI or a title")
        w = self.table("works")
        return w.filter(normalize_doi(F.col("doi")) == normalize_doi(F.lit(doi))) if doi else w.filter(identity_text(F.col("title")) == identity_text(F.lit(title)))

    def stats(self) -> DataFrame:
        """(measure, n)."""
        a, w, p = self.table("artifacts"), self.table("works"), self.table("passages")
        gap = F.exists(F.array(*ledger.SHOWN), lambda x: x == "")
        counts = [("artifacts", a), ("errors", a.filter("error <> ''")), ("works", w), ("provisional", w.filter("identity_status = 'PROVISIONAL_FILENAME'")), ("conflicts", w.filter("identity_conflict <> ''")), ("bibliographic gaps", w.filter(gap)), ("companions", a.filter("artifact_kind = 'STRUCTURED_COMPANION'")), ("unbound companions", a.filter("identity_status = 'COMPANION_UNBOUND'")), ("pending suggestions", self.table("companions").filter("status = 'PENDING'")), ("passages", p)]
        out = a.groupBy("role").agg(F.count("*").alias("n")).select(F.concat(F.lit("role "), "role").alias("measure"), "n")
        for name, rows in counts:
            out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n"))
        return out

    def export_manifest(self) -> DataFrame:
        """One row for each artifact with the fields of its work; as JSON lines (`.write.json`) a manifest."""
        w = self.table("works").select("paper_id", *works.FIELDS, "abstract")
        return self.table("artifacts").select(F.col("source_path").alias("path"), "paper_id", "role", "artifact_kind", "identity_status").join(w, "paper_id").select("path", "paper_id", *works.FIELDS, "abstract", "role", "artifact_kind", "identity_status")

    @staticmethod
    def _companions(artifacts: DataFrame) -> DataFrame:
        a = artifacts.withColumn("directory", F.regexp_replace("source_path", "/[^/]*$", ""))
        free = a.filter("artifact_kind = 'STRUCTURED_COMPANION' AND identity_status = 'COMPANION_UNBOUND'").select("artifact_id", "directory", "stem", "title")
        return works.companions(free, a.filter("artifact_kind <> 'STRUCTURED_COMPANION' AND root_role <> 'PROCESS'").select("paper_id", "directory", "stem", "title"))

    def companion_suggestions(self) -> DataFrame:
        """(companion, its file, work, title, score, basis, status) as stored with the snapshot, best first."""
        a, w = self.table("artifacts").select("artifact_id", "source_rel"), self.table("works").select("paper_id", "title")
        return self.table("companions").join(a, "artifact_id").join(w, "paper_id").orderBy(F.desc("score"), "source_rel", "paper_id")

    def profile_audit(self) -> DataFrame:
        """(source_root, status, kind, value, n): what the roots hold that the profile neither rules nor has seen; a root without such has one row, CURRENT."""
        kept = self.meta()
        roots = {k[5:]: v for k, v in kept.items() if k.startswith("root:")}
        known = self.spark.createDataFrame(side_inputs.known_layout(self.spark, kept.get("profile")), "source_root string, kind string, value string")
        seen = None
        for root, role in roots.items():
            one = files.layout(files.scan(self.spark, {root: role}, content=False)).withColumn("source_root", F.lit(root))
            seen = one if seen is None else seen.unionByName(one)
        new = seen.join(known, ["source_root", "kind", "value"], "left_anti").select("source_root", F.lit("PROFILE_REVIEW").alias("status"), "kind", "value", "n")
        every = self.spark.createDataFrame([(r, "CURRENT", None, None, 0) for r in roots], "source_root string, status string, kind string, value string, n long")
        return new.unionByName(every.join(new.select("source_root").distinct(), "source_root", "left_anti")).orderBy("source_root", "kind", "value")


class Ledger:
    """Recorded evidence beside a corpus; each recording publishes a new snapshot of the ledger."""

    def __init__(self, corpus: Corpus, place: str):
        self.corpus, self.store = corpus, Corpus(corpus.spark, place)

    def adopt(self, rows: DataFrame) -> None:
        """Takes over the rows of an older ledger, keyed by claim: they get evidence ids; of rows that are there already the older stay."""
        keyed = rows.withColumn("evidence_id", ledger.evidence_id(F.col("claim_id"), F.col("paper_id"), F.col("locator_id"))).dropDuplicates(["evidence_id"])
        old = self.rows()
        both = keyed if old is None else old.unionByName(keyed.join(old.select("evidence_id"), "evidence_id", "left_anti"), allowMissingColumns=True)
        both.write.parquet(f"{self.store.place}/v={self.store._next()}/evidence")

    def rows(self) -> DataFrame | None:
        done = self.store._versions("/evidence/_SUCCESS")
        return self.store.table("evidence", done[-1]) if done else None

    def record(self, claim_id: str, claim: str, paper_id: str, locator_id: str, verdict: str, rationale: str = "") -> DataFrame:
        """Checks that the passage is of the work, neither a process file nor a mere companion, and upserts the evidence; returns the work's preflight."""
        if verdict not in ledger.VERDICTS or not claim_id or not claim:
            raise ValueError(f"evidence needs a claim, its id and a verdict of {ledger.VERDICTS}")
        files.check_places({k[5:]: v for k, v in self.corpus.meta().items() if k.startswith("root:")}, self.store.place)
        c, w = self.corpus, self.corpus.table("works").filter(F.col("paper_id") == paper_id)
        a = c.table("artifacts").filter((F.col("paper_id") == paper_id) & (F.col("role") != "PROCESS_EVIDENCE") & (F.col("artifact_kind") != "STRUCTURED_COMPANION")).select("artifact_id", "paper_id")
        spot = c.table("passages").filter(F.col("locator_id") == locator_id).join(a, "artifact_id").join(w.select("paper_id", "bibliography_fingerprint"), "paper_id")
        fresh = spot.select(ledger.evidence_id(F.lit(claim_id), F.col("paper_id"), F.col("locator_id")).alias("evidence_id"), F.lit(claim_id).alias("claim_id"), F.lit(claim).alias("claim_text"), F.lit(verdict).alias("verdict"), F.lit(rationale).alias("rationale"), "paper_id", "artifact_id", "locator_id", "page", "section", F.col("content_hash").alias("source_hash"), F.col("text").alias("supporting_passage"), "bibliography_fingerprint", F.current_timestamp().alias("verified_at"))
        if fresh.isEmpty():
            raise ValueError("the passage is not one of this work's evidence")
        old = self.rows()
        (fresh if old is None else sync.upsert(old, fresh, "evidence_id", "verified_at")).write.parquet(f"{self.store.place}/v={self.store._next()}/evidence")
        return ledger.preflight(w)

    def audit(self) -> DataFrame:
        if (rows := self.rows()) is None:
            raise FileNotFoundError("the ledger is empty")
        c = self.corpus
        now = c.table("passages").join(c.table("artifacts").select("artifact_id", "paper_id"), "artifact_id").select("locator_id", F.col("content_hash").alias("source_hash"), "paper_id", "artifact_id")
        return ledger.audit(rows, now, c.table("works"))


def evaluate(corpus: Corpus, bench: DataFrame, ks: tuple[int, ...] = (20, 50), **options) -> dict:
    """Recall, hard-negative rate and latency of a benchmark (side_inputs.benchmark), and for each query what its wordings find by
    themselves and what is missed. One search for each row and wording; rows are few."""
    spark, found, worded, took = corpus.spark, [], [], []
    rows = bench.select("query_id", "queries", "match").collect()
    search = lambda queries, match: corpus.search(queries, match=match or "all", limit=max(ks), **options).select("paper_id", "rank").collect()
    for r in rows:
        began = time.perf_counter()
        got = search(r["queries"], r["match"])
        took.append(time.perf_counter() - began)
        found += [(r["query_id"], x["paper_id"], x["rank"]) for x in got]
        for i, wording in enumerate(r["queries"]):
            worded += [(r["query_id"], i, x["paper_id"], x["rank"]) for x in (got if len(r["queries"]) == 1 else search([wording], r["match"]))] or [(r["query_id"], i, None, None)]
    ranked = spark.createDataFrame(found, "query_id string, paper_id string, rank int")
    by_wording = spark.createDataFrame(worded, "query_id string, formulation int, paper_id string, rank int")
    relevant, wrong = (bench.select("query_id", F.explode(c).alias("paper_id")) for c in ("relevant_paper_ids", "hard_negative_paper_ids"))
    out: dict = {}
    for k in ks:
        out[f"recall@{k}"] = evaluation.recall(evaluation.hits_at(ranked, relevant, k)).first()[0]
        out[f"hard_negative_rate@{k}"] = evaluation.hard_negative_rate(evaluation.hits_at(ranked, wrong, k)).first()[0]
    out["formulation_recall"] = {(r["query_id"], r["formulation"]): r["recall"] for r in evaluation.formulation_recall(by_wording, relevant, max(ks)).collect()}
    out["missed"] = sorted((r["query_id"], r["paper_id"]) for r in evaluation.missed(ranked, relevant, max(ks)).collect())
    times = sorted(took)
    return out | ({"retrieval_mean_s": sum(times) / len(times), "retrieval_p95_s": times[-(-95 * len(times) // 100) - 1]} if times else {})
