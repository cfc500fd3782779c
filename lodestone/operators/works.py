"""Works from artifacts: field cascade, canonical artifact, conflicts, headings, fingerprints, companions."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import SEARCHED_ROLES, SOURCES, STATUSES, VERSIONS, rank, set_print
from ..functions.text import identity_text, normalize_space, work_title

FIELDS = ["title", "authors", "year", "journal", "doi", "keywords"]
#: Companions: what makes a class of files, what a pair of classes; files of a class in a row; targets of a directory for each share of its candidates.
CLASS, ENDS, CLASS_PART, DIRECTORY_SHARE = ["dir_key", "stem_key", "title_key"], ["dir_key", "a_stem", "a_title", "b_stem", "b_title"], 512, 2000
DUPLICATE = "identical_content_hash_with_distinct_identity:"


def _manifest() -> Column:
    return F.coalesce(F.col("metadata_source"), F.lit("")) == "MANIFEST"


def canonical(artifacts: DataFrame) -> DataFrame:
    """(paper_id, artifact_id) of the best identified artifact; then manifested, best published, primary PDF."""
    best = W.partitionBy("paper_id").orderBy(F.desc(rank(F.col("identity_status"), STATUSES, -1)), F.desc(_manifest()), F.desc(rank(F.col("artifact_version"), VERSIONS)), F.desc(F.col("artifact_kind") == "PRIMARY_PDF"), "source_rel", "artifact_id")
    return artifacts.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("paper_id", "artifact_id")


def field_values(artifacts: DataFrame) -> DataFrame:
    """One row per artifact and non-empty field, with its ranks."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS))
    rows = artifacts.select("paper_id", "artifact_id", "source_rel", _manifest().alias("manifest"), (F.col("artifact_kind") == "PRIMARY_PDF").alias("primary"), rank(F.col("artifact_version"), VERSIONS).alias("version"), "metadata_provenance", F.explode(pairs).alias("p"))
    rows = rows.select("*", "p.field", "p.value").drop("p").filter("value <> ''")
    source = F.coalesce(F.try_element_at("metadata_provenance", "field"), F.lit(""))
    return rows.withColumn("origin", source).withColumn("trust", rank(source, SOURCES)).drop("metadata_provenance")


def cascade(artifacts: DataFrame) -> DataFrame:
    """(paper_id, field, value, origin): for each field the most trusted value."""
    order = W.partitionBy("paper_id", "field").orderBy(F.desc("trust"), F.desc("manifest"), F.desc("primary"), F.desc("version"), "source_rel", "artifact_id")
    return field_values(artifacts).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("paper_id", "field", "value", "origin")


def conflicts(artifacts: DataFrame) -> DataFrame:
    """(paper_id, field, options): several values that tie in all ranks, from PDF metadata or better."""
    ranks = F.struct("trust", "manifest", "primary", "version")
    rows = field_values(artifacts).withColumn("ranks", ranks).filter(normalize_space(F.col("value")) != "")
    best = rows.withColumn("best", F.max("ranks").over(W.partitionBy("paper_id", "field")))
    seen = best.filter((F.col("ranks") == F.col("best")) & (F.col("trust") >= SOURCES["PDF_DOCUMENT_METADATA"]))
    return seen.groupBy("paper_id", "field").agg(F.sort_array(F.collect_set(normalize_space(F.col("value")))).alias("o")).filter(F.size("o") > 1).select("paper_id", "field", F.array_join("o", " | ").alias("options"))


def searched(artifacts: DataFrame) -> Column:
    """Whether an artifact is searched."""
    return (F.col("root_role") != "PROCESS") & F.col("role").isin(SEARCHED_ROLES) & (F.col("artifact_kind") != "STRUCTURED_COMPANION")


def bibliography_print(paper_id: Column, status: Column, provenance: Column, conflict: Column) -> Column:
    """What a citation rests on: the work, how it is identified, the shown fields, where they come from and what conflicts."""
    shown = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "authors", "year", "journal", "doi")]
    told = F.array_join(F.transform(F.array_sort(F.map_entries(provenance)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return F.sha2(F.concat_ws("\x1f", paper_id, status, *shown, told, F.coalesce(conflict, F.lit(""))).cast("binary"), 256)


def works(artifacts: DataFrame) -> DataFrame:
    """One row per work: its fields with their origins, its status, conflicts and three fingerprints."""
    value = lambda f, c: F.coalesce(F.max(F.when(F.col("field") == f, F.col(c))), F.lit(""))
    chosen = cascade(artifacts).groupBy("paper_id").agg(*(value(f, "value").alias(f) for f in FIELDS), F.sort_array(F.collect_list(F.struct("field", "origin"))).alias("_o"))
    chosen = chosen.withColumn("metadata_provenance", F.map_from_entries("_o")).drop("_o")
    prints = artifacts.groupBy("paper_id").agg(
        F.count("*").alias("n_artifacts"),
        set_print(F.col("content_hash")).alias("content_fingerprint"),
        F.max(searched(artifacts)).alias("searched"),
        set_print(F.when(searched(artifacts), F.col("content_hash"))).alias("_searched"),
    )
    best = canonical(artifacts).join(artifacts.select("artifact_id", "identity_status"), "artifact_id").select("paper_id", F.col("artifact_id").alias("canonical_artifact"), "identity_status")
    apart = conflicts(artifacts).groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "field", "options"))), "; ").alias("metadata_conflict"))
    out = prints.join(best, "paper_id").join(chosen, "paper_id", "left").join(apart, "paper_id", "left").fillna("", [*FIELDS, "metadata_conflict"])
    out = out.withColumn("metadata_provenance", F.coalesce("metadata_provenance", F.create_map().cast("map<string,string>")))
    shown = F.concat_ws("\x1f", "paper_id", *FIELDS)
    out = out.withColumn("bibliography_fingerprint", bibliography_print(F.col("paper_id"), F.col("identity_status"), F.col("metadata_provenance"), F.col("metadata_conflict")))
    return out.withColumn("retrieval_fingerprint", F.sha2(F.concat_ws("\x1f", shown, "_searched").cast("binary"), 256)).drop("_searched")


def corpus_prints(w: DataFrame) -> DataFrame:
    """(kind, fingerprint): source of all works, coverage and ranking of the searched ones. 4,096 hash ranges are digested first, then their digests."""
    kinds = [("source", F.concat_ws(":", "paper_id", "content_fingerprint"), F.lit(True)), ("coverage", F.col("paper_id"), F.col("searched")), ("ranking", F.col("retrieval_fingerprint"), F.col("searched"))]
    rows = w.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.when(c, x).alias("x")) for k, x, c in kinds))).alias("r")).select("r.*").filter("x IS NOT NULL")
    parts = rows.groupBy("kind", F.substring(F.sha2(F.col("x").cast("binary"), 256), 1, 3).alias("part")).agg(set_print(F.col("x")).alias("d"))
    return parts.groupBy("kind").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(":", "part", "d")))).cast("binary"), 256).alias("fingerprint"))


def duplicate_contents(artifacts: DataFrame) -> DataFrame:
    """(content_hash, papers): one content under several works."""
    pairs = artifacts.filter(F.coalesce("content_hash", F.lit("")) != "").select("content_hash", "paper_id").distinct()
    return pairs.groupBy("content_hash").agg(F.sort_array(F.collect_list("paper_id")).alias("p")).filter(F.size("p") > 1).select("content_hash", F.array_join("p", ",").alias("papers"))


def without_duplicates(conflict: Column) -> Column:
    """A conflict text without the notes on equal contents, which are written anew each time."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(conflict, F.lit("")), "; "), F.trim), lambda x: (x != "") & ~x.startswith(DUPLICATE)), "; ")


def headings(passages: DataFrame) -> DataFrame:
    """(paper_id, headings): section names in order of first sight, without defaults and page names. `passages` has paper_id, place, section."""
    named = passages.withColumn("section", normalize_space(F.col("section"))).filter(~F.lower("section").rlike(r"^(document body|page\s+[0-9]+)$") & (F.col("section") != ""))
    first = named.groupBy("paper_id", "section").agg(F.min("place").alias("place"))
    return first.groupBy("paper_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "section"))), lambda s: s["section"]), "; ").alias("headings"))


def companion_keys(files: DataFrame) -> DataFrame:
    """`files` (directory, stem, title) with what is compared: dir_key, stem_key, title_key."""
    return files.withColumns({"dir_key": F.lower("directory"), "stem_key": work_title(F.col("stem")), "title_key": identity_text(F.col("title"))})


def _keyed(files: DataFrame, id_col: str) -> DataFrame:
    """(dir_key, stem_key, title_key, id) of each file. Kept, as it is read several times; spills to disk."""
    return companion_keys(files).select(*CLASS, F.col(id_col).alias("id")).persist()


def _classes(rows: DataFrame) -> DataFrame:
    """(dir_key, stem_key, title_key, n, first): the files of equal keys, their number and least id; without files that lack a key."""
    return rows.dropna(subset=CLASS).groupBy(*CLASS).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def _dealt(rows: DataFrame) -> DataFrame:
    """(dir_key, stem_key, title_key, part, ids): the files of equal keys, dealt by id into rows of some CLASS_PART."""
    large = _classes(rows).select(*CLASS, F.ceil(F.col("n") / CLASS_PART).alias("parts")).filter("parts > 1")  # of CLASS_PART files at least, so few
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    return rows.dropna(subset=CLASS).join(F.broadcast(large), CLASS, "left").groupBy(*CLASS, part.alias("part")).agg(F.collect_list(F.struct("id")).alias("ids"))


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _lettered(classes: DataFrame) -> DataFrame:
    """Adds n_title, four words of bits and `above`: of each kind of letter (code point modulo 32) as many bits as letters, 8 at most.

    Letters in common are at most the bits in common and the lesser of what is above.
    """

    def lettered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            bits, above = [], []
            for key in p["title_key"]:
                counts = [0] * 32
                for x, n in Counter(key).items():
                    counts[ord(x) % 32] += n
                bits.append(bytes((1 << min(n, 8)) - 1 for n in counts))
                above.append(sum(n - 8 for n in counts if n > 8))
            words = np.frombuffer(b"".join(bits), "<i8").reshape(-1, 4)
            yield p.assign(n_title=p["title_key"].map(len), above=above, **{f"w{i}": words[:, i] for i in range(4)})

    return classes.mapInPandas(lettered, f"{_kinds(classes)}, n_title int, above int, w0 long, w1 long, w2 long, w3 long")


def _class_pairs(a: DataFrame, b: DataFrame, least: float, n: int) -> DataFrame:
    """(dir_key, a_stem, a_title, a_first, b_stem, b_title, b_first): pairs of classes of one directory whose titles may reach the ratio; none is lost.

    They are joined on the directory and the class of their title's length. The candidates of a directory are dealt into as
    many shares as it has DIRECTORY_SHARE different targets, so no task gets a large directory alone.
    """
    step = F.lit((2 - least) / least * 1.0001)  # lengths differ by less than this factor
    grade = F.floor(F.log(F.greatest(F.col("n_title"), F.lit(1))) / F.log(step)).cast("int")
    shares = b.groupBy("dir_key").agg(F.ceil(F.count("*") / DIRECTORY_SHARE).cast("int").alias("shares")).filter("shares > 1")  # of DIRECTORY_SHARE targets at least, so few
    a, b = (_lettered(x.drop("n")).withColumn("grade", grade).join(F.broadcast(shares), "dir_key", "left").fillna(1, ["shares"]) for x in (a, b))
    a = a.withColumn("share", F.pmod(F.xxhash64("stem_key", "title_key"), F.col("shares")).cast("int")).withColumn("grade", F.explode(F.array(F.col("grade") - 1, F.col("grade"), F.col("grade") + 1)))
    b = b.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    total = F.col("a.n_title") + F.col("b.n_title")
    both = sum((F.bit_count(F.col(f"a.w{i}").bitwiseAND(F.col(f"b.w{i}"))) for i in range(4)), F.least("a.above", "b.above"))
    near = (2 * F.least("a.n_title", "b.n_title") >= least * total) & (2 * both >= least * total)
    met = ["dir_key", "share", "grade"]
    a, b = (x.repartition(n, *met).alias(s) for x, s in ((a, "a"), (b, "b")))  # few bytes, many pairs: not to be gathered by size
    found = a.join(b, [*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in met), near])
    return found.select("a.dir_key", *(F.col(f"{s}.{c}").alias(f"{s}_{c.removesuffix('_key')}") for s in "ab" for c in ("stem_key", "title_key", "first")))


def _judged(a: DataFrame, b: DataFrame, least: float, scored: bool) -> DataFrame:
    """_class_pairs that reach the ratio, with their score: each pair of different keys is judged once, in Python. a, b: of _keyed."""

    def alike(x: str, y: str) -> bool:  # a ratio is at most 2 m / (n1 + n2), m the letters in common, counted with repeats
        total = len(x) + len(y)
        return x == y or (2 * min(len(x), len(y)) >= least * total and 2 * (Counter(x) & Counter(y)).total() >= least * total)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratio = lambda x, y: 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
        for p in batches:
            p = p[[alike(r.a_title, r.b_title) and alike(r.a_stem, r.b_stem) for r in p.itertuples()]]
            s = [min(t := ratio(r.a_title, r.b_title), t if (r.a_stem, r.b_stem) == (r.a_title, r.b_title) else ratio(r.a_stem, r.b_stem)) if scored else 1.0 for r in p.itertuples()]
            yield p.assign(score=pd.Series(s, index=p.index, dtype="float64"))

    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _class_pairs(_classes(a), _classes(b), least, n).repartition(n, *ENDS)
    return pairs.mapInPandas(judge, f"{_kinds(pairs)}, score double").filter(F.col("score") >= least)


def _pairs(candidates: DataFrame, targets: DataFrame, least: float, scored: bool) -> DataFrame:
    """(artifact_id, paper_id, candidate, target, score): what is judged of classes, given to all their files.

    Files meet in tiles of some CLASS_PART on a side, which are dealt over all partitions before their pairs are made.
    """
    a, b = _keyed(candidates, "artifact_id"), _keyed(targets, "paper_id")
    n, judged = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), _judged(a, b, least, scored)
    side = lambda x, s: x.select("dir_key", *(F.col(c).alias(f"{s}_{d}") for c, d in (("stem_key", "stem"), ("title_key", "title"), ("part", "part"), ("ids", "ids"))))
    for x, s in ((a, "a"), (b, "b")):
        judged = judged.join(side(_dealt(x), s), ["dir_key", f"{s}_stem", f"{s}_title"])
    tiles = judged.repartition(n, *ENDS, "a_part", "b_part")
    files = tiles.withColumn("_a", F.explode("a_ids")).withColumn("_b", F.explode("b_ids"))
    return files.select(F.col("_a.id").alias("artifact_id"), F.col("_b.id").alias("paper_id"), F.col("a_title").alias("candidate"), F.col("b_title").alias("target"), "score")


def _offered() -> list[Column]:
    return [F.lit("same directory, stem and title alike; confirmation required").alias("basis"), F.lit("PENDING").alias("status")]


def companion_blocks(candidates: DataFrame, targets: DataFrame, least: float = 0.9) -> DataFrame:
    """(artifact_id, paper_id, candidate, target): pairs of one directory that can reach the ratio, by length and by letters of stem and title; with their titles' keys. No pair is lost."""
    return _pairs(candidates, targets, least, scored=False).drop("score")


def companions(candidates: DataFrame, targets: DataFrame, least: float = 0.9) -> DataFrame:
    """(artifact_id, paper_id, score, basis, status): same directory, both likeness ratios at least `least`; suggestions, never bindings.

    Both sides have: directory, stem, title; candidates artifact_id, targets paper_id.
    """
    found = _pairs(candidates, targets, least, scored=True).select("artifact_id", "paper_id", "score")
    return found.select("*", *_offered())


def companion_classes(candidates: DataFrame, targets: DataFrame, least: float = 0.9) -> DataFrame:
    """The same suggestions between classes of files of equal keys, with the classes' files; so copies add a row each, not one for each pair.

    (kind, candidate_class, target_class, artifact_id, paper_id, score, basis, status). Kind `pair`: a pair of classes, with the
    least artifact_id and paper_id of their files. Kinds `candidate` and `target`: each file with its class (null: it lacks a
    key). Pairs joined with candidates on candidate_class and with targets on target_class are the rows of `companions`.
    """
    a, b = _keyed(candidates, "artifact_id"), _keyed(targets, "paper_id")
    named = lambda stem, title: F.when(F.col("dir_key").isNotNull() & F.col(stem).isNotNull() & F.col(title).isNotNull(), F.sha1(F.to_json(F.array("dir_key", stem, title)).cast("binary")))
    pairs = _judged(a, b, least, scored=True).select(F.lit("pair").alias("kind"), named("a_stem", "a_title").alias("candidate_class"), named("b_stem", "b_title").alias("target_class"), F.col("a_first").alias("artifact_id"), F.col("b_first").alias("paper_id"), "score", *_offered())
    own = named("stem_key", "title_key")
    for x, kind, cls, file in ((a, "candidate", "candidate_class", "artifact_id"), (b, "target", "target_class", "paper_id")):
        pairs = pairs.unionByName(x.select(F.lit(kind).alias("kind"), own.alias(cls), F.col("id").alias(file)), allowMissingColumns=True)
    return pairs
