"""Text functions as Column expressions; the plans keep them inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diacritic folding: Latin letters that decompose into an ASCII letter and marks, and that letter, one for one.
_FOLDED = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}
ACCENTED, PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())
MARKS = "[\u0300-\u036f]"
TOKEN = r"[\p{L}\p{N}\p{M}\p{Co}]+"
WORDY = r"\p{L}\p{N}\p{M}_"
#: What marks an appendix or a correction in a file's name.
APPENDIX_NAMES = ["在线附录", "__附录", "online appendix"]
APPENDIX_MARKS = [
    r"online[\s_.-]*appendix", r"supplement(?:al|ary)?(?:[\s_.-]*material)?", r"supporting[\s_.-]*information",
    r"technical[\s_.-]*appendix", "appendix", "OA", "附录",
]
CORRECTION_MARKS = ["erratum", "correction", "corrigendum", "comments?", "commentary", "rejoinder", "勘误", "更正", "评论与回应"]
FILLERS = ["online", "supplemental", "supplementary", "supporting", "information", "material"]
#: Marks stand between separators; the one after an appendix mark may begin the next.
APPENDIX = rf"(?i)(?:^|[\s_.\-(\[{{])(?:{'|'.join(APPENDIX_MARKS)})(?=$|[\s_.\-)\]}}])"
CORRECTION = rf"(?i)(?:^|[\s_.-])(?:{'|'.join(CORRECTION_MARKS)})(?:[\s_.-]+(?:to|on))?(?:$|[\s_.-])"
#: What a section begins with.
SECTIONS = ["abstract", "introduction", "model", "setting", "analysis", "equilibrium", "results?", "welfare", "discussion", "conclusion", "proof", "appendix", "online appendix", r"[1-9]\.?\s+[A-Z][^.]{2,80}"]
FIELD_NAMES = "title|authors|year|journal|doi|abstract|keywords"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_space(c: Column) -> Column:
    """Soft hyphens go, NUL becomes a space, runs of blanks become one space, line ends stay."""
    return strip(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("­"), F.lit("")), "\x00", " "), r"[ \t\r]+", " "))


def normalize_doi(c: Column) -> Column:
    """The first DOI in lower case, without resolver, prefix and closing punctuation; '' if there is none."""
    bare = F.regexp_replace(F.lower(normalize_space(F.coalesce(c, F.lit("")))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.regexp_replace(F.regexp_extract(bare, rf"(?<![{WORDY}])10\.[0-9]{{4,9}}/[-._;()/:a-z0-9]+", 0), r"[.,;)]+$", "")


def fold_case(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def identity_text(c: Column) -> Column:
    """Case-folded, runs of non-word characters as one space."""
    return F.trim(F.regexp_replace(fold_case(F.replace(F.coalesce(c, F.lit("")), F.lit("\u00ad"), F.lit(""))), rf"[^{WORDY}]+", " "))


def work_title(c: Column) -> Column:
    """The key of a file stem without the marks of its role, so that a work's files share it; the stem itself if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(c, APPENDIX, " "), CORRECTION, " ")
    bare = F.regexp_replace(bare, rf"(?i)(?<![{WORDY}])(?:{'|'.join(FILLERS)})(?![{WORDY}])", " ")
    bare = F.regexp_replace(bare, rf"(?i)^\s*(?:to|for|of|on)(?![{WORDY}])", " ")
    return F.coalesce(F.nullif(fold_case(F.trim(F.regexp_replace(bare, rf"[^{WORDY}]+", " "))), F.lit("")), fold_case(c))


def tokens(c: Column) -> Column:
    """Index tokens: letters, digits, marks and private-use characters; lower case, diacritics folded."""
    plain = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN), MARKS, "")
    return F.regexp_extract_all(F.lower(plain), F.lit(TOKEN), F.lit(0))


def strip_markup(c: Column) -> Column:
    """Script and style bodies go, ends of blocks become blank lines, other tags go, common entities are decoded."""
    out = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?i)</(p|h[1-6]|li|tr|div|w:p|w:tr)>", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<w:tab/>", "\t"), r"<[^>]+>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(normalize_space(out), r"\n[ \n]*\n", "\n\n"))


#: A leading block between lines of ---.
FRONT = r"(?s)^\x{FEFF}?---\s*\n(.*?)\n---\s*(?:\n|$)"


def front_matter(c: Column) -> Column:
    """map of the known keys of a leading block; items of a list in brackets are joined by '; ', of a repeated key the last counts."""
    lines = F.filter(F.split(F.regexp_extract(F.replace(c, F.lit("\r"), F.lit("")), FRONT, 1), "\n"), lambda x: x.rlike(rf"(?i)^({FIELD_NAMES})\s*:"))
    bare = lambda x: F.regexp_replace(strip(x), r"^[\"']+|[\"']+$", "")
    listed = lambda v: F.array_join(F.transform(F.filter(F.split(F.substr(v, F.lit(2), F.char_length(v) - 2), ","), lambda x: strip(x) != ""), bare), "; ")
    told = lambda v: F.when(v.startswith("[") & v.endswith("]"), listed(v)).otherwise(bare(v))
    pair = lambda x: F.struct(F.lower(F.regexp_extract(x, r"^(\w+)", 1)).alias("key"), told(strip(F.regexp_extract(x, r"^\w+\s*:(.*)$", 1))).alias("value"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def abstract_of(c: Column) -> Column:
    """80 to 5000 characters from the word abstract to a line that begins with keywords or introduction; '' otherwise."""
    return normalize_space(F.regexp_extract(c, r"(?is)\babstract\b\s*[:.\-]?\s*(.{80,5000}?)(?=\n\s*(?:keywords?|1\.?\s+introduction|introduction)\b)", 1))


def section_of(c: Column, default: Column | str = "document body") -> Column:
    """A known word or numbered heading at the very start of a passage, else the default."""
    head = F.substring(normalize_space(c), 1, 180)
    found = normalize_space(F.substring(F.regexp_extract(head, rf"(?i)^(?:{'|'.join(SECTIONS)})", 0), 1, 120))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default) if isinstance(default, str) else default)


HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def bound(c: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def headings(c: Column) -> Column:
    """array<struct<section, body>> by ATX headings, in order; what has no text is left out.

    The path of a heading is that of the levels above it as far as they are filled, so skipped levels collapse.
    """
    text = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), FRONT, ""), r"^\x{FEFF}", "")
    begin = F.from_json(F.lit('{"stack":[],"out":[]}'), "struct<stack:array<string>,out:array<string>>")

    def step(acc: Column, line: Column) -> Column:
        above = F.slice(acc["stack"], F.lit(1), F.length(F.regexp_extract(line, HEADING, 1)) - 1)
        title = normalize_space(F.regexp_replace(F.regexp_extract(line, HEADING, 2), "[*_`]", ""))
        return bound(F.concat(above, F.array(title)), lambda s: F.struct(s.alias("stack"), F.concat(acc["out"], F.array(F.array_join(s, " > "))).alias("out")))

    def cut(lines: Column, at: Column, names: Column) -> Column:
        def section(k: Column) -> Column:
            low = F.when(k == 0, 1).otherwise(F.get(at, k - 1) + 2)
            high = F.when(k < F.size(at), F.get(at, k) + 1).otherwise(F.size(lines) + 1)
            name = F.when(k == 0, "document body").otherwise(F.get(names, k - 1))
            return F.struct(name.alias("section"), strip(F.array_join(F.slice(lines, low, high - low), "\n")).alias("body"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(at)), section), lambda s: s["body"] != "")

    marked = lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(HEADING))
    named = lambda lines, at: F.aggregate(F.transform(at, lambda i: F.get(lines, i)), begin, step, lambda acc: acc["out"])
    return bound(F.split(text, "\n"), lambda lines: bound(marked(lines), lambda at: bound(named(lines, at), lambda names: cut(lines, at, names))))
