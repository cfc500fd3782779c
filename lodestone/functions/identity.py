"""Roles, identities, structured file names and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import APPENDIX, APPENDIX_NAMES, CORRECTION, identity_text, normalize_doi, normalize_space, strip

#: Roles, and how much each kind of identity, version and origin of a field is trusted.
ROLES = ["MAIN_ARTICLE", "ONLINE_APPENDIX", "COMMENT_CORRECTION", "PROCESS_EVIDENCE", "OTHER"]
SEARCHED_ROLES = ["MAIN_ARTICLE", "ONLINE_APPENDIX", "COMMENT_CORRECTION"]
STATUSES = {"COMPANION_UNBOUND": -1, "PROVISIONAL_FILENAME": 0, "METADATA_KEY": 1, "MANIFEST_ID": 2, "DOI": 3}
VERSIONS = {"UNSPECIFIED": 0, "PREPRINT": 1, "PUBLISHED_APPENDIX": 2, "PUBLISHED": 3}
SOURCES = {
    "": 0,
    "FILENAME_FALLBACK": 1,
    "LEARNED_FILENAME_PATTERN": 1,
    "DOI_NAMESPACE": 2,
    "MARKDOWN_HEADING": 2,
    "PDF_DOCUMENT_METADATA": 3,
    "MARKDOWN_FRONTMATTER": 4,
    "SOURCE_SECTION": 4,
    "SOURCE_FRONT_MATTER": 5,
    "SOURCE_CITATION_BLOCK": 5,
    "MANIFEST": 6,
}
#: Artifact kinds in their order among passages of one score; all others follow.
KINDS = ["PRIMARY_PDF", "APPENDIX_PDF", "SOURCE_DOCUMENT", "STRUCTURED_COMPANION"]
#: Journals by their code in file names and DOIs.
JOURNALS = {"mksc": "Marketing Science", "mnsc": "Management Science"}
#: A structured name: two digits of the year, code, DOI year, DOI number, artifact code, the rest. Fixed format.
STRUCTURED = r"(?i)^([0-9]{2})_(mksc|mnsc)\.([0-9]{4})\.([0-9]+)_([A-Z]{1,3})_(.+)"


def rank(c: Column, ranks: dict[str, int], other: int = 0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), c), F.lit(other))


def kind_order(c: Column) -> Column:
    return rank(c, {k: i for i, k in enumerate(KINDS)}, len(KINDS))


def hexes(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, n)


def role_of(stem: Column, root_role: Column, ruled: Column) -> Column:
    """Process roots first, then confirmed rules, then markers in the file's name, which stand between separators."""
    lowered = F.lower(stem)
    named = F.lit(False)
    for x in APPENDIX_NAMES:
        named = named | lowered.contains(x)
    marked = F.when(named, "ONLINE_APPENDIX").when(lowered.rlike(CORRECTION), "COMMENT_CORRECTION").when(stem.rlike(APPENDIX), "ONLINE_APPENDIX")
    return F.when(root_role == "PROCESS", "PROCESS_EVIDENCE").otherwise(F.coalesce(ruled, marked, F.lit("MAIN_ARTICLE")))


def role_grounds(role: Column, root_role: Column, ruled: Column) -> tuple[Column, Column]:
    """(confidence, basis) of the role."""
    grounds = [(ruled.isNotNull(), "HIGH", "CORPUS_PROFILE_USER_CONFIRMED"), (role == "ONLINE_APPENDIX", "MEDIUM", "SEMANTIC_FILENAME_MARKER"), (root_role == "PROCESS", "HIGH", "AUTHORIZED_PROCESS_ROOT")]
    level = F.coalesce(*(F.when(c, F.lit(x)) for c, x, _ in grounds), F.lit("LOW"))
    return level, F.coalesce(*(F.when(c, F.lit(x)) for c, _, x in grounds), F.lit("DEFAULT"))


def identity(doi: Column, explicit: Column, title: Column, authors: Column, year: Column) -> tuple[Column, Column]:
    """(work id, status): DOI, then explicit id, then title with authors and a valid year, then title alone."""
    clean, key = normalize_doi(doi), F.concat_ws("|", identity_text(title), identity_text(authors), strip(year))
    whole = (title != "") & (authors != "") & year.rlike("^(18|19|20)[0-9]{2}$")
    named, alone = F.coalesce(explicit, F.lit("")), F.coalesce(F.nullif(identity_text(title), F.lit("")), F.lit("unknown"))
    work = F.when(clean != "", F.concat(F.lit("doi:"), clean)).when(named != "", named).when(whole, F.concat(F.lit("meta:"), hexes(key, 24))).otherwise(F.concat(F.lit("provisional:"), hexes(alone, 24)))
    status = F.when(clean != "", "DOI").when(named != "", "MANIFEST_ID").when(whole, "METADATA_KEY").otherwise("PROVISIONAL_FILENAME")
    return work, status


def structured_name(stem: Column) -> Column:
    """struct<code, year, doi, journal, title> of a structured file name, else null; code is the artifact code."""
    part = lambda i: F.regexp_extract(stem, STRUCTURED, i)
    journal = F.lower(part(2))
    title = F.trim(F.replace(F.element_at(F.split(F.regexp_replace(part(6), r"(?s)__.*$", ""), "_"), -1), F.lit("- "), F.lit(": ")))
    doi = F.concat(F.lit("10.1287/"), journal, F.lit("."), part(3), F.lit("."), part(4))
    named = F.struct(F.upper(part(5)).alias("code"), F.concat(F.lit("20"), part(1)).alias("year"), doi.alias("doi"), journal_of(doi).alias("journal"), title.alias("title"))
    return F.when(stem.rlike(STRUCTURED), named)


def journal_of(doi: Column) -> Column:
    """The journal that a DOI's name space tells, else ''."""
    return F.coalesce(*(F.when(F.lower(doi).contains(f"/{code}."), F.lit(name)) for code, name in JOURNALS.items()), F.lit(""))


def process_name(rel: Column, stem: Column) -> Column:
    """struct<journal, manuscript, year, title> of a file under a process root: by its first folder and its name."""
    folder = F.regexp_extract(rel, "^([^/]+)/", 1)
    journal = F.when(folder == "ManagementScience", "Management Science submission process").when((folder == "MarketingScience") | stem.startswith("MKSC-"), "Marketing Science submission process")
    manuscript = F.upper(F.regexp_extract(stem, r"(?i)^((?:MS|MKSC|JMR)[-_A-Z]*-?[0-9]+(?:-[0-9]+)?)", 1))
    year = F.substring(F.regexp_extract(stem, r"_(20[0-9]{6})_", 1), 1, 4)
    title = F.regexp_replace(stem, r"(?s)__.*$", "")
    return F.struct(F.coalesce(journal, F.nullif(folder, F.lit("")), F.lit("Submission process")).alias("journal"), manuscript.alias("manuscript"), year.alias("year"), title.alias("title"))


def citation_block(front: Column) -> Column:
    """struct<authors, year> of the line that tells how to cite, '' where there is none."""
    pattern = r"(?i)To cite this article:\s*(.+?)\s*\((20[0-9]{2})\)"
    return F.struct(normalize_space(F.regexp_extract(front, pattern, 1)).alias("authors"), F.regexp_extract(front, pattern, 2).alias("year"))


def locator(*cols: Column) -> Column:
    return F.concat(F.lit("loc:"), hexes(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 32))


def set_print(c: Column) -> Column:
    """Aggregate: a fingerprint of the set of values, for sets of one work."""
    return F.sha2(F.concat_ws("\n", F.sort_array(F.collect_set(c))).cast("binary"), 256)
