"""The retrieval engine: parser, readers, ranking against SQLite, fusion, synchronization."""

from __future__ import annotations

import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import identity, text
from lodestone.operators import evaluation, ledger, passages, retrieval, sync, works
from lodestone.plans import query as q
from lodestone.sources import files


def test_safe_queries():
    assert q.safe("solve_model, Café!") == q.And((q.Phrase(("solve", "model")), q.Phrase(("cafe",))))
    assert q.safe("a b", "phrase") == q.Phrase(("a", "b"))
    with pytest.raises(ValueError):
        q.safe("?!")
    with pytest.raises(ValueError):
        q.safe("a", "some")


def test_raw_queries():
    assert q.raw('title:noise* AND ("two words" OR x) NOT y') == q.And((q.Phrase(("noise",), ("title",), True), q.Not(q.Or((q.Phrase(("two", "words")), q.Phrase(("x",)))), q.Phrase(("y",)))))
    assert q.raw("{title body}: ^a + b*") == q.Phrase(("a", "b"), ("title", "body"), True, True)
    assert q.raw("title: (a OR body2)") == q.Or((q.Phrase(("a",), ("title",)), q.Phrase(("body2",), ("title",))))
    for wrong in ("a AND", "(a", "AND b", 'a "', ")", "NEAR(a b, 5)", "supply-chain", "{title: a", "a + ", "{}: a", "a: b: c"):
        with pytest.raises(ValueError):
            q.raw(wrong)


def test_docx_and_places(tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        body = "<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>One &amp; two</w:t><w:tab/><w:t>x</w:t></w:r></w:p><!-- <w:t>no</w:t> --><w:p><w:r><w:t>Three</w:t></w:r></w:p>"
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    assert files.docx_text(raw.getvalue()) == "One & two\tx\n\nThree"
    (tmp_path / "a").mkdir()
    files.check_places({str(tmp_path / "a"): "PAPER"}, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        files.check_places({str(tmp_path): "PAPER", str(tmp_path / "a"): "PROCESS"})
    with pytest.raises(ValueError):
        files.check_places({str(tmp_path / "a"): "PAPER"}, str(tmp_path / "a" / "db"))


def test_scan_and_units(spark, tmp_path):
    (tmp_path / "x.md").write_text("# One\nbody one\n## Two\nbody two\n", encoding="utf-8")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "skip.txt").write_text("no")
    (tmp_path / "link.md").symlink_to(tmp_path / "x.md")
    rows = files.units(files.scan(spark, {str(tmp_path): "PAPER"})).collect()
    assert {(r["section"], r["text"]) for r in rows if not r["error"]} == {("One", "body one"), ("One > Two", "body two")}
    assert [r["source_path"].rsplit("/", 1)[-1] for r in rows if r["error"]] == ["bad.docx"]


def test_bm25_equals_sqlite(spark):
    rows = [("a", "red fish", "one fish two fish red fish"), ("b", "blue", "blue whale and red fish"), ("c", "none", "nothing here at all"), ("d", "fish", "a fish of red"), ("e", "Cafe\u0301", "caf\u00e9")]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, body, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite has no full-text module")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    df, cols = spark.createDataFrame(rows, "id string, title string, body string"), ["title", "body"]
    index = retrieval.Index(retrieval.Index.postings_of(df, "id", cols).cache(), *retrieval.Index.statistics(df, cols))
    raws = ["title : fish*", "{title body} : red + fish", "^red", "body : ^one", "(red OR blue) NOT whale", "cafe", "r* AND body : f*"]
    for mine, theirs in [(q.safe("red fish", "phrase"), '"red fish"'), (q.safe("red whale", "any"), "red OR whale"), (q.safe("red fish"), "red AND fish"), *((q.raw(x), x) for x in raws)]:
        want = dict(con.execute("SELECT id, bm25(t, 0, 5, 1) FROM t WHERE t MATCH ?", (theirs,)).fetchall())
        for found in (retrieval.bm25(index, mine, {"title": 5.0, "body": 1.0}), retrieval.bm25_rows(df, "id", mine, {"title": 5.0, "body": 1.0})):
            got = {r["id"]: r["score"] for r in found.collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), theirs


def test_fusion_goes_by_rank_and_first_sight(spark):
    arms = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (1, "y", 1), (1, "z", 2)], "arm int, paper_id string, rank int")
    assert [r["paper_id"] for r in retrieval.fuse(arms).orderBy("rank").collect()] == ["y", "x", "z"]


def test_failed_replacements_keep_their_old_state(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (5, "e")], "k int, v string")
    changes = sync.diff(old, new, "k", ["v"])
    assert {tuple(r) for r in changes.collect()} == {(1, "unchanged"), (2, "replaced"), (3, "removed"), (4, "added"), (5, "added")}
    failed = spark.createDataFrame([(2,), (5,)], "k int")
    assert sorted(tuple(r) for r in sync.apply(old, new, changes, "k", failed).collect()) == [(1, "a"), (2, "b"), (4, "d"), (5, "e")]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, v {kind}")
    return [r[1] for r in rows.select("n", f(F.col("v")).alias("out")).orderBy("n").collect()]


def test_text_functions(spark):
    dois = ["https://doi.org/10.1287/mnsc.2020.1234.", "doi: 10.1000/XYZ-1)", "see http://dx.doi.org/10.5555/a;b,", "10.1000/abc|foo", "x10.1000/abc", "none", "", None]
    assert column(spark, dois, text.normalize_doi) == ["10.1287/mnsc.2020.1234", "10.1000/xyz-1", "10.5555/a;b", "10.1000/abc", "", "", "", ""]
    stems = ["Pricing OA", "Error-correction models", "Pricing - Online Appendix", "Pricing correction", "Pricing (Supplementary Material)", "定价 附录", "On Pricing", "Comments on Pricing"]
    assert column(spark, stems, text.work_title) == ["pricing", "error models", "pricing", "pricing", "pricing", "定价", "pricing", "pricing"]
    role = lambda c: identity.role_of(c, F.lit("PAPER"), F.lit(None).cast("string"))
    assert column(spark, stems, role) == ["ONLINE_APPENDIX", "COMMENT_CORRECTION", "ONLINE_APPENDIX", "COMMENT_CORRECTION", "ONLINE_APPENDIX", "ONLINE_APPENDIX", "MAIN_ARTICLE", "COMMENT_CORRECTION"]
    assert column(spark, ["Scorrections", "boarding"], role) == ["MAIN_ARTICLE", "MAIN_ARTICLE"]
    long = "We measure how noise in prices changes what buyers learn, an introduction to data on many markets."
    assert column(spark, [f"Abstract: {long}\nKeywords: x", f"ABSTRACT\n{long}\n1. Introduction", "Abstract: short\nKeywords: x", None], text.abstract_of) == [long, long, "", None]
    assert column(spark, ["INTRODUCTION we", "2.1 Demand model of x. y", "3. Demand model of x. y", "the rest"], text.section_of) == ["INTRODUCTION", "document body", "3. Demand model of x", "document body"]
    assert column(spark, ["---\nTITLE: 'A'\ntitle: B\nkeywords: [\"x\", y, ]\n---\nz", "no", None], text.front_matter) == [{"title": "B", "keywords": "x; y"}, {}, None]
    assert column(spark, ["a\n# T\nb\n### D\nc\n### E\nd", "", None], lambda c: F.transform(text.headings(c), lambda s: F.concat_ws("|", s["section"], s["body"]))) == [["document body|a", "T|b", "T > D|c", "T > D > E|d"], [], None]


def test_passages_join_by_a_space_and_overlap(spark):
    paragraphs = [f"{chr(97 + i)} " * 240 + "end." for i in range(5)] + ["y" * 3000]
    got = column(spark, ["\n\n".join(paragraphs), "", None], lambda c: F.transform(passages.packed(c), lambda p: F.struct(p["at"], p["end"], p["text"])))
    want, buf, start, cursor = [], "", 0, 0
    for p in paragraphs:
        if len(p) > 1400:
            if buf:
                want.append((start, start + len(buf), buf))
            buf = ""
            want += [(cursor + i, cursor + i + len(p[i : i + 1400]), p[i : i + 1400]) for i in range(0, len(p) - 220, 1180)]
        elif buf and len(buf) + 1 + len(p) > 1400:
            want.append((start, start + len(buf), buf))
            start, buf = max(0, cursor - 220), f"{buf[-220:]} {p}".strip()
        else:
            start, buf = (start if buf else cursor), f"{buf} {p}".strip()
        cursor += len(p) + 1
    assert [tuple(x) for x in got[0]] == want and not got[1] and not got[2]


def test_pdf_properties_and_pages(monkeypatch):
    listing = "Title:   On  Noise\nAuthor: A. B\nSubject: Management Science 2019, vol. 1\nKeywords:\nPages: 3"
    assert files.told_properties(listing) == {"title": "On Noise", "authors": "A. B", "year": "2019", "journal": "Management Science"}
    monkeypatch.setattr(files.shutil, "which", lambda name: None)
    assert files.pdf_properties(b"x") == {}
    with pytest.raises(RuntimeError):
        files.pdf_pages(b"x")


def test_audit_tells_what_is_stale(spark):
    kind = "evidence_id string, locator_id string, paper_id string, artifact_id string, source_hash string, bibliography_fingerprint string"
    rows = [("ok", "l", "w", "a", "h", "b"), ("no print", "l", "w", "a", "h", None), ("empty", "l", "w", "a", "h", ""), ("other work", "l", "v", "a", "h", "b"), ("other file", "l", "w", "z", "h", "b"), ("changed", "l", "w", "a", "i", "b"), ("gone", "m", "w", "a", "h", "b"), ("print", "l", "w", "a", "h", "c"), ("no work", "n", "x", "a", "h", "b")]
    now = spark.createDataFrame([("l", "h", "w", "a"), ("n", "h", "x", "a")], "locator_id string, source_hash string, paper_id string, artifact_id string")
    got = {r["evidence_id"]: r["status"] for r in ledger.audit(spark.createDataFrame(rows, kind), now, spark.createDataFrame([("w", "b")], "paper_id string, bibliography_fingerprint string")).collect()}
    assert got == {"ok": "CURRENT", "no print": "BIBLIOGRAPHY_STALE", "empty": "BIBLIOGRAPHY_STALE", "print": "BIBLIOGRAPHY_STALE", "no work": "BIBLIOGRAPHY_STALE"} | dict.fromkeys(("other work", "other file", "changed", "gone"), "SOURCE_STALE")
    assert ledger.stale_since({"ranking_fingerprint": "a"}, {"ranking_fingerprint": "b"}) == ["RANKING_STALE"]


def test_the_main_paper_goes_first_among_passages_of_one_score(spark):
    rows = spark.createDataFrame([("w", "a", "APPENDIX_FILE", -1.0), ("w", "b", "PRIMARY_PDF", -1.0), ("w", "c", "APPENDIX_PDF", -2.0)], "paper_id string, id string, kind string, score double")
    best = retrieval.best_per_work(rows.withColumn("kind_order", identity.kind_order(F.col("kind"))), 3)
    assert [r["id"] for r in best.orderBy("place").collect()] == ["c", "b", "a"]


def test_wordings_are_judged_by_themselves(spark):
    ranked = spark.createDataFrame([("q", 0, "x", 1), ("q", 0, "y", 2), ("q", 1, None, None)], "query_id string, formulation int, paper_id string, rank int")
    good = spark.createDataFrame([("q", "x"), ("q", "z")], "query_id string, paper_id string")
    assert {(r["formulation"], r["recall"]) for r in evaluation.formulation_recall(ranked, good, 5).collect()} == {(0, 0.5), (1, 0.0)}


def test_fingerprints_follow_what_they_stand_for(spark):
    base = {"paper_id": "w", "artifact_id": "a", "source_rel": "a", "root_role": "PAPER", "role": "MAIN_ARTICLE", "artifact_kind": "PRIMARY_PDF", "artifact_version": "PUBLISHED", "identity_status": "DOI", "metadata_source": "MANIFEST", "title": "T", "authors": "A", "year": "2000", "journal": "J", "doi": "10.1/x", "keywords": "", "content_hash": "h", "metadata_provenance": {"title": "MANIFEST"}}
    kinds = ", ".join(f"{k} {'map<string,string>' if k == 'metadata_provenance' else 'string'}" for k in base)
    prints = lambda *rows: works.works(spark.createDataFrame([tuple((base | r).values()) for r in rows], kinds)).first()
    one = prints({})
    told = prints({"metadata_provenance": {"title": "MARKDOWN_HEADING"}})
    assert told["bibliography_fingerprint"] != one["bibliography_fingerprint"] and told["retrieval_fingerprint"] == one["retrieval_fingerprint"]
    archive = prints({}, {"artifact_id": "z", "artifact_kind": "ARCHIVE_ATTACHMENT", "role": "OTHER", "content_hash": "i"})
    assert archive["content_fingerprint"] != one["content_fingerprint"] and archive["retrieval_fingerprint"] == one["retrieval_fingerprint"]
    tied = prints({}, {"artifact_id": "z", "title": "U", "content_hash": "i"})
    assert tied["metadata_conflict"] == "title=T | U" and tied["bibliography_fingerprint"] != one["bibliography_fingerprint"]
    assert prints({}, {"artifact_id": "z", "title": "U", "metadata_provenance": {"title": "MARKDOWN_FRONTMATTER"}})["title"] == "T"


def test_ranks_without_a_limit_run_over_all_partitions(spark):
    rows = spark.range(1000).repartition(7).withColumn("s", F.col("id") % 97)
    got = retrieval.ranked(rows, F.desc("s"), F.col("id")).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(1000), key=lambda i: (-(i % 97), i)) and {r["rank"] for r in got} == set(range(1, 1001))
    assert retrieval.ranked(rows.limit(0), F.col("id")).collect() == []
