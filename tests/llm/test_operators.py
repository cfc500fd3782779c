"""The ten operators against brute force, and their defined cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe_codec, fingerprint, mixing, nearest, quality, secrets, simhash_dedup, substring_dedup, token_counts, warc
from lodestone.llm.queries import QUERIES, tokenizer_path

DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, size string"
RND = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(60)] + ["é", "ß日", "😀", "it's"]


def prose(n: int) -> str:
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


COMMON = prose(30)
TEXTS = [None, "", " \n\t", "one", "two words", prose(200), prose(5000), COMMON, f"{prose(40)} {COMMON} {prose(20)}", f"{COMMON}\n{prose(9)}", "nb sp \x1c x", *(prose(60) for _ in range(6))]
TEXTS += [TEXTS[5], TEXTS[8] + " tail", TEXTS[5].replace("w1 ", "w2 ", 1)]
ROWS = [(i, t, None if i % 7 == 3 else "en", [None, "a", "b", "", "é"][i % 5], None) for i, t in enumerate(TEXTS)] + [(None, COMMON, None, None, 1), (4, "two words", "en", "é", 9), (-3, prose(50), "de", "a", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    """With clashing extra columns, nulls, a repeated id and a null id."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def words(t: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_substring_dedup(docs, none):
    first: dict = {}
    for i, t, *_ in ROWS:
        w = words(t)
        for p in range(len(w) - 12):
            if i is not None:
                k = tuple(w[p : p + 13])
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t, *_ in ROWS:
        w, gone = words(t), set()
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = [tuple(r) for r in substring_dedup.drop_repeated_passages(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 60
    assert substring_dedup.drop_repeated_passages(none).count() == 0


def brute_fp(t: str | None) -> int:
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", w)
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(docs, none):
    fps = [brute_fp(r[1]) for r in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            group[i] = min(group[j] for j in range(len(ROWS)) if (fps[i] ^ fps[j]).bit_count() <= 3)
    want = []
    for i, r in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if group[j] == group[i] and ROWS[j][0] is not None]
        want.append((r[0], fps[i] - (fps[i] >> 63 << 64), min(ids, default=None)))
    got = [tuple(r) for r in simhash_dedup.simhash_classes(docs).select("id", "fp", "component").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").isEmpty() and not kept.filter("doc_id IS NULL").isEmpty()
    assert simhash_dedup.simhash_classes(none).count() == 0 and simhash_dedup.near_dedup(none).count() == 0


def test_links_and_components_on_random_fingerprints(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        fps |= {f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))) for _ in range(4)}
    signed = lambda x: x - (x >> 63 << 64)
    found = {tuple(r) for r in simhash_dedup.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    want = {(a, b) for x in fps for y in fps if (a := signed(x)) < (b := signed(y)) and (x ^ y).bit_count() <= 3}
    assert found == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in simhash_dedup.components(chain).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_nearest_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:] = x[:800] + 0.05 * rng.standard_normal((800, 16)).astype(np.float32)
    x[10] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (None, [1.0] * 16), (5200, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest.nearest(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = y @ y[q]
        s[q] = -9
        best = set(np.lexsort((np.arange(1500), -s))[:5].tolist())
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - s[r["id"]]) < 1e-12 for r in mine)
        hit += len(best & {r["id"] for r in mine})
    assert hit / 150 >= 0.9
    assert {r["query_id"] for r in got} == set(range(0, 1500, 50))
    assert nearest.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (p, g, n) in enumerate((("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t, re.ASCII) if len(m[g]) >= n]
    return sorted(out)


def test_secrets(spark, none):
    rnd = random.Random(2)
    key = lambda n, a: "".join(rnd.choice(a) for _ in range(n))
    hexes, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [None, "", "😀 Password = 'abc' TOKEN:abcdef.g=", f"AKIA{key(16, 'ABC234')} x", f"é {key(24, hexes)} {key(23, hexes)}", 'secret: "token"=abcdefg', "api_key=1234567 apikey: 'zz'", "kelvin toKen=abcdef"]
    texts += [f"see {key(40, b62)} here" for _ in range(40)] + [f"{key(18, hexes)} word" for _ in range(30)] + ["Aa1" * 14] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan(docs).withColumn("w", secrets.written(F.col("spans"))).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i]["_base"]] == base_spans(t or "")
    random_kind = [i for i in range(len(texts)) if "random" in got[i]["w"]]
    assert len([i for i in random_kind if 8 <= i < 48]) >= 36 and not [i for i in random_kind if i >= 78]
    assert secrets.scan(none).count() == 0
    masked = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert masked[0] is None and masked[2] == "😀 Password = 'abc' [secret]" and masked[3] == "[secret] x"


def test_battery_against_plain_python(spark):
    run = "a8F3kZ0qLm91XvT7bRw2"
    alphabet = secrets.ENCODINGS["base64"][1]
    c, n, a = [alphabet.index(x) for x in run], len(run), 64
    uniform = (a / n * sum(c.count(x) ** 2 for x in range(a)) - n - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n)
    side = [x >= 32 for x in c]
    both = 2 * sum(side) * (n - sum(side))
    runs = (1 + sum(x != y for x, y in zip(side, side[1:])) - 1 - both / n) / math.sqrt(both * (both - n) / (n * n * (n - 1)))
    m = 31.5
    serial = sum((x - m) * (y - m) for x, y in zip(c, c[1:])) / sum((x - m) ** 2 for x in c) * math.sqrt(n)
    two = lambda z: math.erfc(abs(z) / math.sqrt(2))
    y = -math.log(two(uniform) / 2 if uniform > 0 else 1 - two(uniform) / 2) - math.log(two(runs)) - math.log(two(serial))
    want = math.exp(-y) * (1 + y + y * y / 2)
    rows = spark.createDataFrame([(run,)], "text string")
    assert abs(secrets.with_candidates(rows).select(F.col("_tested")[0]["p"]).first()[0] - want) < 2e-3


def test_fingerprints_and_edited_texts(docs, none):
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = fingerprint.edited_pairs(docs).collect()
    by = {(r["id"], r["n_chars"]): r for r in got}
    assert len(got) == len(ROWS)
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, k = r[1] or "", len(r[1] or "") // 3
        mine = by[r[0], len(t)]
        if r[0] not in (4, 5):  # 4 is repeated with one text
            assert mine["edited_text"] == t[: len(t) - k] + (nxt[1] or "")[:k]
    same = {}
    for r in got:
        if r["id"] in (5, TEXTS.index(TEXTS[5], 6)):
            same[r["id"]] = r["fp"]
    assert len(set(same.values())) == 1
    assert fingerprint.edited_pairs(none).count() == 0
    long = docs.select(F.lit(1).alias("doc_id"), F.lit("ab cd " * 70_000).alias("text")).limit(1)
    assert fingerprint.edited_pairs(long).first()["fp"] != 0


def test_permuted_tables_find_all_within_the_radius(spark):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        fps |= {f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))) for _ in range(5)}
    signed = lambda x: x - (x >> 63 << 64)
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [tuple(r) for r in fingerprint.within(rows, rows, 3).collect()]
    assert len(set(got)) == len(got)
    assert set(got) == {(signed(a), signed(b), (a ^ b).bit_count()) for a in fps for b in fps if (a ^ b).bit_count() <= 3}


def test_token_counts(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = token_counts.token_counts(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    want = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in ROWS]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got if r["doc_id"] is not None) == sorted(w for w in want if w[0] is not None)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and any(r["over_limit"] for r in got)
    assert token_counts.token_counts(none, tokenizer_path("piece_bpe_32k.model")).count() == 0


ODD = ["a  b", " lead", "trail ", "x\n\ny", "a▁b", "<|endoftext|> a<|endoftext|>", "don't 12 !?", "\x1c\x85 z", "tab\tx", "日本語 текст", "é" * 300, "(†\r", "<s></s><unk>"]


def test_both_tokenizers_on_odd_texts():
    import pyarrow as pa
    import sentencepiece
    import tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    count, codec = token_counts.counter(tokenizer_path("piece_bpe_32k.model")), bpe_codec.codec(tokenizer_path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice(ODD + [" ", "\n", "the", "ing"]) for _ in range(rnd.randint(0, 9))) for _ in range(500)]
    assert count(pa.array(texts)).tolist() == [len(model.encode(t)) for t in texts]
    ids = codec.encode_all(pa.array(texts)).to_pylist()
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(map(codec.decode, ids)) == [library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]


def test_bpe_round_trip(docs, none):
    path = tokenizer_path("byte_bpe_50k.json")
    back = bpe_codec.decoded(bpe_codec.encoded(docs, path, keep=("lang",)), path).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in back) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    assert bpe_codec.encoded(none, path).count() == 0
    once = bpe_codec.round_trip(docs, path, keep=("lang",))
    assert once.filter("NOT whole OR whole IS NULL").isEmpty()
    once = once.drop("whole").collect()
    assert sorted(map(repr, once)) == sorted(map(repr, back))
    assert bpe_codec.round_trip(none, path).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix(mixing.sized(docs)).collect()
    total = sum(len(words(r[1])) for r in ROWS)
    sources: dict = {}
    for r in ROWS:
        sources[r[3]] = sources.get(r[3], 0) + len(words(r[1]))
    names = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None]
    weight, target, left, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, dict.fromkeys(names, 0.0), 1.5 * total, set(names)
    while left > 1e-9 and open_:
        w, rest = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / w
            if target[s] >= 2 * sources[s]:
                rest += target[s] - 2 * sources[s]
                target[s] = 2.0 * sources[s]
                open_.discard(s)
        left = rest
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2 and r["source_size"] == sources[r["source"]]
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 97 AS int)) AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 4)) AS source")
    rows = mixing.mix(mixing.sized(many)).selectExpr("source", "target", "copies * size AS taken").groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.02 * r["target"] + 100 for r in rows)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(mixing.sized(none)).count() == 0


def test_warc(spark):
    html = ["<p>é\r\n\r\nWARC/1.1</p>", None, "", "<p>same</p>", "<p>same</p>", "<p>same</p>", "x" * 300_000, "<p>twice</p>"]
    rows = [(i, None if i == 2 else f"https://h.org/a b{i}", h, "clash") for i, h in enumerate(html)] + [(7, "https://h.org/7", "<p>twice</p>", "clash"), (None, "u", "<p>same</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    last: dict = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        fresh = i == last[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if fresh else "revisit", None if fresh else last[h or ""]))
    number = lambda f, k: int(f[k]) if k in f else None
    mine = [(number(r["metadata"]["fields"], "page"), r["payload_bytes"], r["payload_digest"], r["type"], number(r["metadata"]["fields"], "refers-to-page")) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert all(r["request"]["http_head"].startswith("GET ") for r in got)
    place = warc.archive_place(spark)
    warc.write_archive(pages, place)
    full = warc.assemble(warc.read_records(spark, place)).filter("type = 'response'").collect()
    assert {bytes(r["response"]["payload"]).decode() for r in full} == {h or "" for h in html}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_quality(spark, none):
    rnd = random.Random(8)
    good = [" ".join(rnd.choice(["the", "market", "shows", "prices", "rise."]) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(rnd.choice(["BUY!!", "NOW!!", "$$$", "|"]) for _ in range(40)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(901, None), (None, 1)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, net).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values()) and abs(got[900] - got[901]) < 1e-9
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i in range(300)]) > 0.97
    lone = quality.train(docs, labels.limit(0))
    assert all(r["score"] == 0.5 for r in quality.scored(docs, lone).collect())
    assert quality.scored(none, net).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(80) for _ in range(60)] + ["BUY!! NOW!! " * 40] * 20 + [None, "", f"{prose(60)} password=b7db7aa4a5fcc78305"]
    texts += [texts[0], texts[1] + " w1"]
    spark.createDataFrame([(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert ids and not ids & set(range(60, 80)) and len(texts) - 2 not in ids
    assert all(r["whole"] for r in out) and max(r["n_chars"] or 0 for r in out) > 0


def test_queries_run_on_the_smallest_tables(spark):
    assert list(QUERIES) == [f"op{i}_{n}" for i, n in enumerate("substring_dedup nearest secrets fingerprints token_counts mixing bpe_codec warc simhash_dedup quality".split(), 1)]
    out = QUERIES["op4_fingerprints"](spark, "/root/testdata/sf0.001")
    assert out.count() == 200
    mean = out.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert mean[0] > mean[1] + 0.1
