"""The corpus of files: build, search, update, ledger."""

from __future__ import annotations

import json
import os
import zipfile

import pytest

from lodestone.__main__ import main
from lodestone.corpus import Corpus, Ledger, evaluate
from lodestone.sources import side_inputs

FISH = "Red fish swim in the cold river while the old mill turns slowly through the night. "
BIRD = "Grey birds nest above the harbour and watch the boats return before the storm. "


def docx(path, *paragraphs: str) -> None:
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def paper(path, doi: str, body: str) -> None:
    docx(path, f"doi: {doi} To cite this article: A. Author (2020) {path.stem}.", body * 3)


def test_corpus_from_build_to_audit(spark, tmp_path, capsys):
    def encoder(texts: list[str]) -> list[list[float]]:
        return [[float("fish" in t.lower()), float("bird" in t.lower()), 0.1] for t in texts]

    root, place = tmp_path / "papers", str(tmp_path / "corpus")
    root.mkdir()
    paper(root / "On fish.docx", "10.1000/fish", FISH)
    paper(root / "On birds.docx", "10.1000/bird", BIRD)
    (root / "bad.docx").write_bytes(b"no archive")
    (root / "On fish.md").write_text("Loose notes that nobody signed. " * 5)  # the stem alone binds nothing
    corpus = Corpus(spark, place)
    with pytest.raises(FileNotFoundError):
        corpus.version  # noqa: B018
    corpus.build({str(root): "PAPER"})
    stats = {r["measure"]: r["n"] for r in corpus.stats().collect()}
    assert (stats["artifacts"], stats["errors"], stats["works"], stats["passages"], stats["unbound companions"], stats["pending suggestions"]) == (4, 1, 4, 3, 1, 1)
    offer = corpus.companion_suggestions().first()
    assert (offer["source_rel"], offer["paper_id"], offer["score"], offer["status"]) == ("On fish.md", "doi:10.1000/fish", 1.0, "PENDING")

    hits = corpus.search(["fish"]).collect()
    assert [r["paper_id"] for r in hits] == ["doi:10.1000/fish"] and "Red fish" in hits[0]["passages"][0]["text"]
    assert (hits[0]["authors"], hits[0]["year"], [a["artifact_kind"] for a in hits[0]["artifacts"]]) == ("A. Author", "2020", ["SOURCE_DOCUMENT"])
    assert corpus.search(["harbour"]).collect() == []  # the index of works holds no text
    assert [r["paper_id"] for r in corpus.search(["harbour"], rescue=True).collect()] == ["doi:10.1000/bird"]
    with pytest.raises(ValueError):
        corpus.search(["fish"], roles=["NONE"])
    with pytest.raises(ValueError):
        corpus.search(["fish"], strategy="semantic")
    with pytest.warns(UserWarning):
        corpus.search(["鱼类"])
    assert corpus.lookup(doi="https://doi.org/10.1000/FISH").count() == corpus.lookup(title="On  Birds!").count() == 1

    with pytest.raises(ValueError):
        corpus.embed(encoder, "m", "")
    corpus.embed(encoder, "m", "1")
    assert [r["paper_id"] for r in corpus.search(["a bird"], strategy="semantic", encoder=encoder, model="m", revision="1", limit=1).collect()] == ["doi:10.1000/bird"]
    assert corpus.search(["a bird"], strategy="semantic", encoder=encoder, model="m", revision="2").collect() == []
    assert corpus.search(["fish"], strategy="hybrid", encoder=encoder, model="m", revision="1").first()["paper_id"] == "doi:10.1000/fish"

    spot = corpus.passage_search("doi:10.1000/fish", "mill").first()
    assert corpus.inspect(locator_id=spot["locator_id"]).count() == corpus.inspect(paper_id="doi:10.1000/fish").count() == 1
    book = Ledger(corpus, str(tmp_path / "ledger"))
    assert book.record("c1", "Fish swim", "doi:10.1000/fish", spot["locator_id"], "SUPPORTED").first()["identity_accepted"]
    loose = corpus.inspect(paper_id=next(r["paper_id"] for r in corpus.table("works").collect() if r["paper_id"].startswith("companion:"))).first()
    for work, place_, verdict in (("doi:10.1000/bird", spot["locator_id"], "SUPPORTED"), ("doi:10.1000/fish", spot["locator_id"], "MAYBE"), ("doi:10.1000/fish", loose["locator_id"], "SUPPORTED")):
        with pytest.raises(ValueError):
            book.record("c1", "Fish swim", work, place_, verdict)
    with pytest.raises(ValueError):
        Ledger(corpus, str(root / "ledger")).record("c1", "Fish swim", "doi:10.1000/fish", spot["locator_id"], "SUPPORTED")
    assert [r["status"] for r in book.audit().collect()] == ["CURRENT"]

    bench = tmp_path / "bench.json"
    bench.write_text(json.dumps([{"query_id": "q", "queries": ["fish", "whales"], "match": "any", "relevant_paper_ids": ["doi:10.1000/fish", "none"], "hard_negative_paper_ids": ["doi:10.1000/bird"]}]))
    measured = evaluate(corpus, side_inputs.benchmark(spark, str(bench)), ks=(1,))
    assert (measured["recall@1"], measured["hard_negative_rate@1"], measured["missed"]) == (0.5, 0.0, [("q", "none")])
    assert measured["formulation_recall"] == {("q", 0): 0.5, ("q", 1): 0.0}

    # One changes, one breaks, one comes, an archive comes; then a corpus without passages is refused.
    before = corpus.meta()
    paper(root / "On fish.docx", "10.1000/fish", FISH.replace("cold", "very warm"))
    docx(root / "On birds.docx", "x")  # too short for a passage
    paper(root / "On mills.docx", "10.1000/mill", "Mills grind grain for bread beside every river of the county, all year round. ")
    (root / "data.zip").write_bytes(b"PK any bytes")
    assert corpus.update() == {"added": 2, "replaced": 2, "unchanged": 2}
    assert all(corpus.meta()[f"{k}_fingerprint"] != before[f"{k}_fingerprint"] for k in ("source", "coverage", "ranking"))
    assert sorted(r["paper_id"] for r in corpus.search(["fish OR on"], raw=True).collect()) == ["doi:10.1000/bird", "doi:10.1000/fish", "doi:10.1000/mill"]
    assert [r["status"] for r in book.audit().collect()] == ["SOURCE_STALE"]
    assert main(["lookup", place, "--doi", "10.1000/mill"]) == 0 and json.loads(capsys.readouterr().out)["paper_id"] == "doi:10.1000/mill"
    assert main(["search", str(tmp_path / "nowhere"), "x"]) == 2 and main(["inspect", place, "--locator", "none"]) == 0
    zipped = corpus.table("artifacts").filter("extension = '.zip'").first()
    assert (zipped["artifact_kind"], zipped["error"], len(zipped["content_hash"])) == ("ARCHIVE_ATTACHMENT", "", 64)
    # Bytes may change within size and time; only hashing tells.
    seen = os.stat(root / "data.zip")
    (root / "data.zip").write_bytes(b"PK ANY bytes")
    os.utime(root / "data.zip", ns=(seen.st_atime_ns, seen.st_mtime_ns))
    (root / "On mills.docx").unlink()
    assert corpus.update(verify_hash=True) == {"removed": 1, "replaced": 2, "unchanged": 3}  # what failed is tried again
    for file in root.iterdir():
        file.unlink()
    (root / "data.zip").write_bytes(b"PK")
    version = corpus.version
    with pytest.raises(RuntimeError):
        corpus.update()
    assert corpus.version == version and corpus.export_manifest().count() == 5


def test_manifest_profile_and_names_decide(spark, tmp_path):
    root, process, place = tmp_path / "papers", tmp_path / "process", str(tmp_path / "corpus")
    for folder in (root, process / "ManagementScience"):
        folder.mkdir(parents=True)
    paper(root / "one.docx", "10.1000/noted", FISH)
    docx(root / "20_mnsc.2019.1234_AB_x_On Noise- Part.docx", BIRD * 2)
    docx(root / "21_MKSC.2020.77_CD_On Rain.docx", BIRD * 3)
    (root / "two.md").write_text("# *Loose* words\n" + BIRD * 2)
    (root / "three.md").write_text(f"---\r\ntitle: Signed\r\nauthors: [A, B]\r\nyear: 2001\r\n---\r\n# Introduction\r\n{FISH * 2}")
    docx(process / "ManagementScience" / "MS-MNSC-12-34_20190304_letter.docx", FISH * 2)
    listed, ruled = tmp_path / "m.json", tmp_path / ".lodestone" / "corpus_profile.json"
    ruled.parent.mkdir()
    listed.write_text(json.dumps([{"path": "one.docx", "paper_id": "mine", "title": "Stated", "doi": "10.1000/stated"}]))
    rule = {"role": "COMMENT_CORRECTION", "version": "PUBLISHED", "basis": "USER_CONFIRMED"}
    profile = {"profile_version": 1, "corpora": [{"root": str(root), "artifact_codes": {"AB": rule}, "observed_structure": {"extensions": [".docx", ".md"], "unmatched_prefixes": ["one", "two", "three"]}}]}
    ruled.write_text(json.dumps(profile))
    roots = {str(root): "PAPER", str(process): "PROCESS"}
    assert side_inputs.discover_profile(list(roots)) == side_inputs.discover_profile([str(root)]) == str(ruled)
    corpus = Corpus(spark, place)
    corpus.build(roots, str(listed))
    a = {r["source_rel"].rsplit("/", 1)[-1]: r for r in corpus.table("artifacts").collect()}
    told = lambda name, *fields: tuple(a[name][f] for f in fields)
    assert told("one.docx", "paper_id", "title", "authors", "identity_conflict") == ("doi:10.1000/stated", "Stated", "A. Author", "manifest_doi=10.1000/stated content_doi=10.1000/noted")
    assert a["one.docx"]["metadata_provenance"] == {"title": "MANIFEST", "doi": "MANIFEST", "authors": "SOURCE_CITATION_BLOCK", "year": "SOURCE_CITATION_BLOCK"}
    name = "20_mnsc.2019.1234_AB_x_On Noise- Part.docx"
    assert told(name, "paper_id", "title", "year", "journal", "role", "role_confidence", "role_basis", "artifact_version") == ("doi:10.1287/mnsc.2019.1234", "On Noise: Part", "2020", "Management Science", "COMMENT_CORRECTION", "HIGH", "CORPUS_PROFILE_USER_CONFIRMED", "PUBLISHED")
    assert told("21_MKSC.2020.77_CD_On Rain.docx", "role", "role_confidence", "role_basis", "journal") == ("MAIN_ARTICLE", "LOW", "DEFAULT", "Marketing Science")
    assert told("two.md", "artifact_kind", "identity_status", "title") == ("STRUCTURED_COMPANION", "COMPANION_UNBOUND", "Loose words")
    assert told("three.md", "identity_status", "title", "authors") == ("METADATA_KEY", "Signed", "A; B") and a["three.md"]["paper_id"].startswith("meta:")
    assert told("MS-MNSC-12-34_20190304_letter.docx", "paper_id", "role", "role_basis", "year", "journal") == ("MS-MNSC-12-34", "PROCESS_EVIDENCE", "AUTHORIZED_PROCESS_ROOT", "2019", "Management Science submission process")
    assert corpus.table("works").filter("paper_id = 'doi:10.1000/stated'").first()["identity_conflict"].startswith("manifest_doi=")
    new = {(r["status"], r["kind"], r["value"]) for r in corpus.profile_audit().filter(f"source_root = '{root}'").collect()}
    assert new == {("PROFILE_REVIEW", "code", "CD")}
    export = {r["path"].rsplit("/", 1)[-1]: r for r in corpus.export_manifest().collect()}
    assert export["three.md"]["paper_id"] == a["three.md"]["paper_id"] and export["one.docx"]["title"] == "Stated"
    rule["basis"] = "GUESSED"
    ruled.write_text(json.dumps(profile))
    with pytest.raises(ValueError):
        side_inputs.profile(spark, str(ruled), [str(root)])
    for records in ([{"path": "one.docx"}, {"path": str(root / "one.docx")}], [{"path": "none.docx"}], [{"path": "one.docx", "role": "NONE"}]):
        listed.write_text(json.dumps(records))
        with pytest.raises(ValueError):
            corpus.update()
