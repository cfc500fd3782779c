"""Companion suggestions against a plain double loop."""

from __future__ import annotations

import difflib
import random
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import functions as F

from lodestone.operators import works
from lodestone.plans.catalog import QUERIES, companion_sides
from lodestone.sources.tables import artifacts


def expanded(rows):
    """All pairs of files, of pairs of classes and the classes of files."""
    pairs, a, b = rows.filter("kind = 'pair'"), rows.filter("kind = 'candidate'"), rows.filter("kind = 'target'")
    return pairs.drop("artifact_id", "paper_id").join(a.select("candidate_class", "artifact_id"), "candidate_class").join(b.select("target_class", "paper_id"), "target_class")


def test_appendix_files_meet_all_other_artifacts(spark, tmp_path):
    rnd = random.Random(6)
    topics = [[f"{w}{i}" for w in ("River", "fish", "of", "the", "cold", "north", "in", "spring")] for i in range(4)]
    texts = [" ".join([topics[i % 4][0], *rnd.sample(topics[i % 4][1:], rnd.choice((6, 7, 7)))]) if rnd.random() < 0.6 else " ".join(topics[i % 4][: rnd.choice((7, 8))]) for i in range(120)] + ["", "Ünder", "ünder"]
    rows = [(i, t, "en", rnd.choice(("src1", "SRC1", "src17", "src18")), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda t: t.lower()  # titles are words and single spaces
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    arts, want = artifacts(spark, str(tmp_path)).collect(), []
    for a in arts:
        for b in arts:
            if a["artifact_kind"] == "APPENDIX_FILE" != b["artifact_kind"] and b["root_role"] != "PROCESS" and a["title"].split(" ")[0].lower() == b["title"].split(" ")[0].lower():
                score = ratio(key(a["title"]), key(b["title"]))  # the mark of an appendix is no part of a stem's key
                if score >= 0.9:
                    want.append((a["artifact_id"], b["paper_id"], score))
    got = [(r["artifact_id"], r["paper_id"], r["score"]) for r in expanded(QUERIES["companion_suggestions"](spark, str(tmp_path))).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)
    blocks = QUERIES["companion_blocking"](spark, str(tmp_path)).select("artifact_id", "paper_id").collect()
    assert {w[:2] for w in want} <= {tuple(r) for r in blocks}


def test_files_of_equal_keys_are_judged_once_and_all_returned(spark, monkeypatch):
    """Several shares of a directory, several tiles of a class, letters above eight; against a plain double loop. Only classes are joined on letters and scored."""
    monkeypatch.setattr(works, "CLASS_PART", 7)
    monkeypatch.setattr(works, "DIRECTORY_SHARE", 3)
    scored = spark.sparkContext.accumulator(0)

    def counted(*a):
        scored.add(1)
        return difflib.SequenceMatcher(*a)

    monkeypatch.setattr(works, "difflib", SimpleNamespace(SequenceMatcher=counted))
    rnd = random.Random(8)
    base = "the eerie cheese tree seemed green 鱼类 ünd e" + "e" * 9
    titles = ["", "e" * 30, "e" * 34, "e" * 40, *("".join(rnd.choice("ex ü鱼") if rnd.random() < 0.06 else c for c in base) for _ in range(30))]
    dealt = [(titles[min(int(rnd.expovariate(0.15)), 33)], rnd.choice("AaB")) for _ in range(400)]
    rows = [(str(i), d, t.title(), t) for i, (t, d) in enumerate(dealt)] + [("none", None, "e", "e"), ("null", "A", None, None)]
    a = spark.createDataFrame(rows[::2], "artifact_id string, directory string, stem string, title string").repartition(5)
    b = spark.createDataFrame(rows[1::2] + rows[-1:] + rows[1:2], "paper_id string, directory string, stem string, title string").repartition(3)
    a_rows, b_rows = (works.companion_keys(x).dropna().collect() for x in (a, b))
    letters = lambda x, y: not x + y or 2 * (Counter(x) & Counter(y)).total() >= 0.9 * len(x + y)
    blocks, offers = [], []
    for x in a_rows:
        for y in b_rows:
            s1, t1, s2, t2 = x["stem_key"], x["title_key"], y["stem_key"], y["title_key"]
            if x["dir_key"] == y["dir_key"] and letters(t1, t2) and letters(s1, s2):
                blocks.append((x["artifact_id"], y["paper_id"], t1, t2))
                score = min(difflib.SequenceMatcher(None, s1, s2).ratio(), difflib.SequenceMatcher(None, t1, t2).ratio())
                offers += [(x["artifact_id"], y["paper_id"], score)] if score >= 0.9 else []
    assert len(offers) > 1000 and sorted(map(tuple, works.companion_blocks(a, b).collect())) == sorted(blocks)
    assert sorted(map(tuple, works.companions(a, b).select("artifact_id", "paper_id", "score").collect())) == sorted(offers)
    assert 0 < scored.value < len(blocks) / 3


def test_copies_add_rows_not_pairs(spark, tmp_path, monkeypatch):
    """A row for each file and each pair of classes, however many copies; all pairs follow from them. Copies of one title land in several rows of files."""
    monkeypatch.setattr(works, "CLASS_PART", 16)
    texts = ["River fish of the cold north in spring", "River fish of the cold north in springs", "River fish of a cold north in spring", "other words"]
    rows = [(i, texts[(i // 2) % 4 if i % 10 < 2 else 0], "en", "src1", 0) for i in range(600)] + [(600, None, "en", "src1", 0), (601, None, "en", "src1", 0), (602, texts[0], "en", "src18", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = companion_sides(spark, str(tmp_path))
    got = QUERIES["companion_suggestions"](spark, str(tmp_path)).cache()
    n = {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
    assert n == {"candidate": 301, "target": 301, "pair": 10} and got.filter("artifact_id IS NULL AND paper_id IS NULL").count() == 0
    pairs = expanded(got).select("artifact_id", "paper_id", "score").collect()
    assert len(pairs) > 80000 and sorted(map(tuple, pairs)) == sorted(map(tuple, works.companions(a, b).select("artifact_id", "paper_id", "score").collect()))
    least = got.filter("kind = 'pair'").join(got.filter("kind = 'candidate'").groupBy("candidate_class").agg(F.min("artifact_id").alias("least")), "candidate_class").select("artifact_id", "least").collect()
    assert len(least) == 10 and all(r["artifact_id"] == r["least"] for r in least)
    assert max(works._dealt(works._keyed(a, "artifact_id")).selectExpr("size(ids) AS n").collect())["n"] < 64


def test_titles_are_the_first_eight_words(spark, tmp_path):
    texts = ["", " .,", "a", "-a b\nc", "a b c d e f g h i j", "1 2 3 4 5 6 7 eight-nine", "\n\n Über 鱼类, x_y źw " * 5, None, "x" * 30000, "." * 30000 + "a b", "a." * 30000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'src1' AS source", "0 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    whole = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 8), " ")
    rows = artifacts(spark, str(tmp_path)).select("doc_id", "title", whole.alias("whole")).collect()
    assert len(rows) == len(texts) and all(r["title"] == r["whole"] for r in rows)
