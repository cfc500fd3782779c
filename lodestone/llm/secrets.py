"""Secret scans: fixed patterns, and a battery of randomness tests, in DataFrame operations only.

Three kinds of spans come from patterns: assign, access and hex (`PATTERNS`). The battery adds spans of the kind random:
runs of 16 or more characters that a key encoding can produce; where a run fits no encoding as a whole, its parts between
separators are runs of their own (`PART`). The encoding is inferred from the characters (`ENCODINGS`; letters alone infer
none, words would pass). Each run is read as numbers of its alphabet and tested three ways: chi-squared
uniformity over the alphabet, the number of runs below and above the middle, and the correlation of neighbours. Moments
are the exact ones for the run's length, so short runs are judged by what their length can show. The three p-values are
combined by Fisher's rule. A key is a run that does not fail: p is uniform for keys and near zero for the rest. How low a
p may be is settled for each stratum of encoding and length class over the whole input: the number of keys is estimated
from the upper half of p, and the cut is the lowest at which at most `FALSE_SHARE` of the accepted runs exceed what keys
explain (a false-discovery control). Only the table of counts by stratum and hundredth of p (bounded) reaches the driver.

Positions count code points, ends are exclusive. Defined cases: a null text is an empty text; patterns of one kind do not
overlap; a random span that meets a pattern's span is not added; ties in start go by the order of kinds; repeated rows
and rows with a null id each get their spans; the caller's columns travel in one struct, so that none clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

KINDS = ("assign", "access", "hex", "random")
#: kind: pattern, group whose length counts, least length.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
CANDIDATE, PART, LEAST = r"[A-Za-z0-9+/_-]{16,}", r"[A-Za-z0-9]+", 16
#: Matches are placed in blocks of so many, so that no long array is copied for each.
FOLD = 512
LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: encoding: what the run must look like, its alphabet. The first that fits is taken.
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    "HEX": (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UP + "234567"),
    "base36": (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOW),
    "BASE36": (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UP),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/]+$", UP + LOW + DIGITS + "+/"),
    "base64url": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z_-]+$", UP + LOW + DIGITS + "-_"),
}
FALSE_SHARE, BINS = 0.1, 100


def found(text: Column, pattern: str) -> Column:
    """array<struct<at, end, body>> of the leftmost non-overlapping matches. What lies between matches gives the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<at:long,end:long,body:string>>")
    first = F.struct(F.lit(0).cast("long").alias("pos"), none.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["pos"] + F.char_length(pair["gap"])
        end = at + F.char_length(pair["hit"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), end.alias("end"), pair["hit"].alias("body")))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        placed = F.aggregate(part, F.struct(acc["last"]["pos"].alias("pos"), none.alias("out")), step)
        return F.struct(placed.alias("last"), F.concat(acc["all"], F.array(acc["last"]["out"])).alias("all"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / FOLD).cast("int")), lambda q: F.slice(pairs, q * FOLD + 1, FOLD))
    start = F.struct(first.alias("last"), F.array().cast("array<array<struct<at:long,end:long,body:string>>>").alias("all"))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, block, lambda acc: F.flatten(F.concat(acc["all"], F.array(acc["last"]["out"]))))).otherwise(none)


def _kept(spans: Column, kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    long = lambda s: F.char_length(F.regexp_extract(s["body"], pattern, group)) >= least
    return F.transform(F.filter(spans, long), lambda s: F.struct(s["at"].alias("at"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def tail(z: Column) -> Column:
    """The two-sided normal tail (a logistic approximation, within 0.0002)."""
    z = F.abs(z)
    return 2 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def judged(runs: Column) -> Column:
    """array<struct<at, end, stratum, p>> of candidates (array<struct<at, end, body>>) that some encoding fits.

    Each transform names what the next one reads, so that nothing is computed twice.
    """
    zero, alphabets = F.lit(0).cast("double"), F.array(*(F.lit(a) for _, a in ENCODINGS.values()))
    total = lambda xs: F.aggregate(xs, zero, lambda s, x: s + x)
    beside = lambda xs, f: F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), f)

    def inferred(r: Column) -> Column:
        encoding = F.coalesce(*(F.when(r["body"].rlike(shape), F.lit(i)) for i, (shape, _) in enumerate(ENCODINGS.values())))
        return F.struct(r["at"].alias("at"), r["end"].alias("end"), r["body"].alias("body"), encoding.alias("encoding"))

    def coded(r: Column) -> Column:
        alphabet = F.get(alphabets, r["encoding"])
        codes = F.transform(F.split(r["body"], ""), lambda c: F.call_function("instr", alphabet, c) - 1)
        n = F.char_length(r["body"]).cast("double")
        stratum = (r["encoding"] * 32 + F.floor(F.log2(n) + 1e-9)).cast("int")
        return F.struct(r["at"].alias("at"), r["end"].alias("end"), stratum.alias("stratum"), n.alias("n"), F.char_length(alphabet).alias("size"), codes.alias("codes"))

    def summed(r: Column) -> Column:
        codes, half, middle = r["codes"], r["size"] / 2, (r["size"] - 1) / 2
        counts = F.transform(F.sequence(F.lit(0), r["size"] - 1), lambda a: F.size(F.filter(codes, lambda c: c == a)).cast("double"))
        squares = total(F.transform(counts, lambda c: c * c))
        ones = total(F.transform(codes, lambda c: F.when(c >= half, 1.0).otherwise(0.0)))
        turns = total(beside(codes, lambda a, b: F.when((a >= half) != (b >= half), 1.0).otherwise(0.0)))
        around = total(F.transform(codes, lambda c: (c - middle) * (c - middle)))
        product = total(beside(codes, lambda a, b: (a - middle) * (b - middle)))
        named = {"squares": squares, "both": 2 * ones * (r["n"] - ones), "runs": 1 + turns, "around": around, "product": product}
        return F.struct(*(r[c].alias(c) for c in ("at", "end", "stratum", "n", "size")), *(v.alias(k) for k, v in named.items()))

    def scored(r: Column) -> Column:
        n, free = r["n"], r["size"] - 1
        uniform = (r["size"] / n * r["squares"] - n - free) / F.sqrt(2 * free * (n - 1) / n)
        spread = r["both"] * (r["both"] - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (r["runs"] - 1 - r["both"] / n) / F.sqrt(spread)).otherwise(F.sqrt(n))
        serial = F.when(r["around"] > 0, r["product"] / r["around"] * F.sqrt(n)).otherwise(F.sqrt(n))
        return F.struct(*(r[c].alias(c) for c in ("at", "end", "stratum")), F.array(uniform, runs, serial).alias("z"))

    def tailed(r: Column) -> Column:
        tails = F.transform(r["z"], lambda z, i: F.when(i > 0, tail(z)).when(z > 0, tail(z) / 2).otherwise(1 - tail(z) / 2))
        return F.struct(*(r[c].alias(c) for c in ("at", "end", "stratum")), total(F.transform(tails, lambda p: -F.ln(F.greatest(p, F.lit(1e-300))))).alias("y"))

    def combined(r: Column) -> Column:
        return F.struct(*(r[c].alias(c) for c in ("at", "end", "stratum")), (F.exp(-r["y"]) * (1 + r["y"] + r["y"] * r["y"] / 2)).alias("p"))

    def opened(r: Column) -> Column:
        inner = F.filter(found(r["body"], PART), lambda p: F.char_length(p["body"]) >= LEAST)
        apart = F.transform(inner, lambda p: inferred(F.struct((r["at"] + p["at"]).alias("at"), (r["at"] + p["end"]).alias("end"), p["body"].alias("body"))))
        return F.when(r["encoding"].isNotNull() | ~r["body"].rlike("[^A-Za-z0-9]"), F.array(r)).otherwise(apart)

    out = F.filter(F.flatten(F.transform(F.transform(runs, inferred), opened)), lambda r: r["encoding"].isNotNull())
    for f in (coded, summed, scored, tailed, combined):
        out = F.transform(out, f)
    return out


def with_candidates(docs: DataFrame, carry: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `carry` of `docs` (all, if None) as the struct doc, _base (array<struct<at, kind, end>>) and _tested (array<struct<at, end, stratum, p>>)."""
    docs = docs.select(F.struct(*(f"`{c}`" for c in carry or docs.columns)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    docs = docs.withColumns({f"_{k}": found(text, v[0]) for k, v in PATTERNS.items()}).withColumn("_runs", found(text, CANDIDATE))
    base = F.array_sort(F.concat(*(_kept(F.col(f"_{k}"), k) for k in PATTERNS)))
    return docs.withColumn("_base", base).withColumn("_tested", judged(F.col("_runs"))).drop("_runs", "_text", *(f"_{k}" for k in PATTERNS))


def thresholds(tested: DataFrame) -> dict[int, float]:
    """The least p accepted in each stratum (2 where none is), from the counts over all rows of `tested`."""
    runs = tested.select(F.explode("_tested").alias("r")).select("r.stratum", F.least(F.floor(F.col("r.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict[int, list[int]] = {}
    for row in runs.groupBy("stratum", "bin").count().collect():  # at most 7 encodings x 32 length classes x 100 bins
        counts.setdefault(row["stratum"], [0] * BINS)[row["bin"]] = row["count"]
    out = {}
    for stratum, bins in counts.items():
        keys = min(sum(bins), 2 * sum(bins[BINS // 2 :]))
        out[stratum] = 2.0
        above = 0
        for b in reversed(range(BINS)):
            above += bins[b]
            expected = keys * (BINS - b) / BINS
            if above and above - expected <= FALSE_SHARE * above + 1:
                out[stratum] = b / BINS
        if keys == 0:
            out[stratum] = 2.0
    return out


def with_spans(tested: DataFrame, cuts: dict[int, float]) -> DataFrame:
    """`tested` with spans, array<struct<at, kind, end>> in order of start, then kind."""
    base, limit = F.col("_base"), F.lit(2.0)
    table = F.create_map(*(F.lit(x) for kv in sorted(cuts.items()) for x in kv)) if cuts else None
    clear = lambda r: ~F.exists(base, lambda b: (b["at"] < r["end"]) & (r["at"] < b["end"]))
    passed = lambda r: (r["p"] >= (F.coalesce(F.try_element_at(table, r["stratum"]), limit) if cuts else limit)) & clear(r)
    added = F.transform(F.filter("_tested", passed), lambda r: F.struct(r["at"].alias("at"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    return tested.withColumn("spans", F.array_sort(F.concat(base, added))).drop("_tested")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _base, spans) of every row."""
    tested = settle(with_candidates(docs, (id_col,), text_col))
    return with_spans(tested, thresholds(tested)).select(F.col(f"doc.{id_col}").alias(id_col), "_base", "spans")


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """`docs` with each span (overlapping ones as one) of the text replaced by `mask`; a null text stays null."""
    tested = settle(with_candidates(docs, None, text_col))
    spanned = with_spans(tested, thresholds(tested))
    text = F.col(f"doc.{text_col}").cast("string")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["pos"] + 1).cast("int"), F.greatest(s["at"] - acc["pos"], F.lit(0)).cast("int"))
        out = F.when(s["at"] >= acc["pos"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substr(text, (acc["pos"] + 1).cast("int"), F.char_length(text)))
    masked = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(text)
    return spanned.select(*((masked if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
