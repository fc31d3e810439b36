"""Every numbered query on the smallest tables, and every operator on odd rows."""

import base64
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from brute import base_secrets, near_duplicates, repeats
from pyspark.sql import functions as F

from ruleloom.llm import bloom, components, embed, lengths, media, neardup, packing, pieces, quality, queries, secrets, suffix, tokens, urls
from ruleloom.llm.common import Scratch

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, kept boolean, n_shingles int"
R = random.Random(7)
VOCABULARY = ["the", "of", "Zug", "é", "naïve", "token", "a", "schön", "x1", "#tag"] + ["".join(R.choice("abcdefgh") for _ in range(5)) for _ in range(300)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, n, r=R):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


def odd_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows; columns with clashing names."""
    base, passage = prose(120), prose(60)
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one"), (6, "ONE two"), (7, base), (8, base), (9, edited(base, 1)), (10, edited(base, 2)), (11, edited(base, 60)), (12, prose(50) + " " + passage + " " + prose(40)), (13, passage + prose(30)), (14, prose(10) + passage), (15, "be " * 400), (16, "be " * 390 + "x"), (17, prose(9000)), (18, "é" * 700), (19, "\x00\t漢字👍" * 40), (20, base), (20, base)]
    rows += [(100 + i, edited(base, R.randrange(0, 14))) for i in range(120)]
    return [(i, t, None, None, 3) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return {i: t for i, t, *_ in rows}, spark.createDataFrame([*rows, (None, "no id " * 30, None, None, 1)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


# 1 secrets


def check_secrets(rows, docs):
    for r in rows:
        want = base_secrets(docs[r.doc_id])
        named = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in named.split(",") if s]


def test_op1(spark, documents):
    rows = queries.op1_secret_scans(spark, DIR).collect()
    assert len(rows) == len(documents)
    check_secrets(rows, documents)


def word_model(spark):
    words = spark.createDataFrame([(w,) for w in ["ordinary", "identifier", "schoenewoerter", "thequickbrownfox", "get_value_of_key", "readTheWholeFile", "jumpsoverlazydog"] * 30], "token string")
    none = spark.createDataFrame([], "doc_id long, text string")
    return secrets.train(secrets.labelled_samples(none).unionByName(words.withColumn("label", F.lit(0))))


def test_secrets_on_odd_rows(spark):
    key = base64.b64encode(bytes(range(90, 120))).decode()
    texts = [None, "", "no secrets here", "password=short", "secret=token:abcdefgh and TOKEN : 'abcdef12'", "é👍 api_key=ABCDEFGH.x AKIA" + "Z9" * 8 + "!", "f" * 24 + " " + "f" * 23, f"see {key} there", "thequickbrownfoxjumpsoverthelazydog", "4041894974608795", "x" * 50_000, "password=" + "a1" * 12 + " " + "0f" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none, model = docs.where("doc_id < 0"), word_model(spark)
    found = secrets.scan(docs, model)
    spans = {r.doc_id: r.s for r in found.select("doc_id", secrets.listed("__spans").alias("s")).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base_secrets(t))
        assert ",".join(s for s in spans[i].split(",") if not s.startswith("random")) == base, i
    assert spans[7] == f"random:4:{4 + len(key)}"
    assert spans[8] == "" and spans[9] == "" and spans[10] == ""
    clean = {r.doc_id: r.text for r in secrets.redact(found).collect()}
    assert clean[0] is None and clean[2] == texts[2] and clean[7] == "see [SECRET] there" and clean[5].startswith("é👍 [SECRET] [SECRET]")
    assert secrets.scan(none, model).count() == 0


def test_secrets_of_long_texts_take_linear_time(spark):
    """One token of a million characters; a hundred thousand tokens; very many secrets in one text."""
    import time

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = lambda n: "".join(R.choices(letters, k=n))
    texts = ["see " + token(1_000_000) + " there", " ".join(token(20) for _ in range(100_000)), " ".join(f"token={token(12)}é" for _ in range(30_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    model = word_model(spark)
    df.write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    found = secrets.scan(df, model)
    rows = {r.doc_id: r for r in found.select("doc_id", secrets.listed("__spans").alias("spans"), F.size("__base").alias("n")).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(found).select("doc_id", "text").collect()}
    assert time.perf_counter() - began < 40
    assert rows[0].spans == "random:4:1000004" and clean[0] == "see [SECRET] there"
    assert rows[1].spans.count("random") > 70_000 and rows[2].n == 30_000
    assert clean[2] == " ".join(["[SECRET]é"] * 30_000)
    spans = [tuple(map(int, s.split(":")[1:])) for s in rows[1].spans.split(",")]
    want, at = [], 0
    for a, b in spans:
        want += [texts[1][at:a], "[SECRET]"]
        at = b
    assert clean[1] == "".join([*want, texts[1][at:]])


# 2 URLs


def test_url_parts_and_rules(spark):
    rows = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/7a?x", "http://a.example.com/en/1", "http://example.net/de/81#f", "http://net/de/", "http://b.net", "http://xcom/en/1", "ftp://org/es/é#x", "http://a.b.c/x?y", "http://a.b.c/x.html", "http://www.a.b.c/x/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)] * 2, "page_id long, url string, host string")
    listed = spark.createDataFrame([("a.b.c/x",), ("a.b.c/x",), (None,), ("example.com/en/7a",)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, listed).collect()}
    assert urls.judged(pages, listed).count() == 2 * len(rows)
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/7a", "example.com/en/7", "allow")
    assert got[5][2:] == ("com/en/", "block") and got[6] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[7] == ("net", "/de/", "net/de/", "allow") and got[8] == ("b.net", "", None, "allow") and got[9][2] is None and got[10][2] == "org/es/"
    assert [got[i][3] for i in (11, 12, 13)] == ["block"] * 3
    assert urls.RULES == [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    assert {r.verdict for r in urls.judged(pages, listed.where("false")).where("rule is null").collect()} == {"allow"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("pages", "labels", "documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    rel = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(str([r[k] for k in rel.columns]) for r in got.collect()) == sorted(str(list(r)) for r in rel.fetchall())


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    blocks = bloom.blocks_for(3000)
    seen = bloom.probed(spark.range(9000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), "id"), "k", bloom.build(keys, "k", blocks), blocks)
    assert seen.where("id < 3000 and not __possible").count() == 0
    assert seen.where("id >= 3000 and __possible").count() < 200
    assert bloom.blocks_for(10**12) == bloom.MAX_BLOCKS


# 3 quality


def test_op3_on_held_out_rows(spark):
    got = queries.op3_quality(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.predicted == r.quality for r in held]) >= 0.9


@pytest.mark.parametrize("prior,clamped", [(0.3, False), (0.95, True)])
def test_risk_against_a_plain_version(prior, clamped):
    """Loss, clamp and gradient, by a loop over rows and by differences."""
    r = np.random.default_rng(4)
    xp, xu, w = r.normal(1, 1, (20, 5)), r.normal(1.2, 1, (30, 5)), r.normal(size=5) * 0.5
    soft = lambda z: np.log(1 + np.exp(z))

    def plain(w):
        first = prior * sum(soft(-(x @ w)) for x in xp) / len(xp)
        second = sum(soft(x @ w) for x in xu) / len(xu) - prior * sum(soft(x @ w) for x in xp) / len(xp)
        return first, second

    if clamped:
        xu = xu - 3 * np.sign(w)  # what is unlabelled looks negative, so the second part is below zero
    first, second, g = quality.risk(w, xp, xu, prior)
    assert np.allclose((first, second), plain(w)) and (second < 0) == clamped
    follow = (lambda w: -plain(w)[1]) if clamped else (lambda w: sum(plain(w)))
    steps = np.eye(5) * 1e-6
    assert np.allclose(g, [(follow(w + s) - follow(w - s)) / 2e-6 for s in steps], atol=1e-6)


def test_a_null_id_is_not_held_out(spark):
    got = spark.createDataFrame([(None,), (7,)], "doc_id long").select(F.coalesce(~quality.learnable(), F.lit(False)).alias("h")).collect()
    assert [x.h for x in got] == [False, zlib.crc32(b"7") % 5 == 0]


def test_prior_is_estimated_without_negative_labels():
    rng = np.random.default_rng(3)
    for prior in (0.3, 0.6, 0.9):
        good = rng.random(6000) < prior
        x = rng.random((9000, quality.N_FEATURES)) * 0.1
        x[:, 3] += np.concatenate([np.ones(3000), good]) * 0.2  # 3000 positives, then unlabelled rows
        order = rng.permutation(9000)
        p = (np.arange(9000) < 3000)[order]
        assert abs(quality.estimated_prior(x[order], p, ~p) - prior) < 0.04
    assert quality.best_bin(np.array([0.9, 0.8, 0.8, 0.7]), np.array([0.9, 0.8, 0.1, 0.1])) == 0.5
    assert quality.estimated_prior(x[:3], np.ones(3, bool), np.ones(3, bool)) == 0.5


def test_quality_on_odd_rows(spark, odd, empty):
    docs, df = odd
    labels = spark.createDataFrame([(i, 1 if i != 15 else 0) for i in docs if i < 130 or i > 200] + [(9999, None), (None, 1)], "doc_id long, quality int")
    model = quality.trained(df.select("doc_id", "text"), labels, quality.learnable())
    got = quality.scored(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.kept(df, model).columns == df.columns
    assert quality.trained(empty, labels.where("false"), quality.learnable()) is None
    assert quality.scored(empty, None).count() == 0 and quality.kept(df, None).count() == df.count()


# 4 pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(queries.public_tokenizers.path("piece_bpe_32k.model"))


def test_op4(spark, documents, codec):
    for r in queries.op4_sentencepiece(spark, DIR).collect():
        ids = codec.library.encode(documents[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()


def test_pieces_equal_the_library(codec):
    letters = [*"abcdefghijklmno    ▁<>0189\n\t\x00éß漢👍", "  ", "the", "ing", "   ", "<s>", "<0x41>", "İ"]
    texts = ["".join(R.choice(letters) for _ in range(R.choice([0, 1, 2, 5, 30, 300]))) for _ in range(800)] + ["a" * 5000, " " * 999, "x y" * 900, "é" * 60]
    for t, (ids, n, back) in zip(texts, codec.encoded(texts), strict=True):
        want = codec.library.encode(t)
        assert ids == ",".join(map(str, want)) and n == len(want)
        assert back == codec.library.decode(want) == codec.decode(want)
        assert codec.heap("▁" + t.replace(" ", "▁")) == want or not t


def test_long_chunks_are_not_remembered(codec):
    """A script without spaces: each text is one chunk."""
    before = len(codec.ids_of)
    texts = ["".join(chr(R.randrange(0x4E00, 0x9FA0)) for _ in range(300)) for _ in range(200)]
    got = codec.encoded(texts)
    assert len(codec.ids_of) == before and len(codec.text_of) == before
    assert [g[0] for g in got] == [",".join(map(str, codec.library.encode(t))) for t in texts]


def test_each_chunk_is_compared_once_with_the_library(monkeypatch):
    c, asked = pieces.Codec(queries.public_tokenizers.path("piece_bpe_32k.model")), []

    class Spy:
        decode = c.library.decode

        def encode(self, x, real=c.library, **more):
            asked.extend([x] if isinstance(x, str) else x)
            return real.encode(x, **more)

    c.library = Spy()
    assert c.encoded(["alpha beta alpha"] * 50)[0][2] == "alpha beta alpha"
    c.encoded(["beta  alpha", "beta "])
    assert sorted(asked) == ["a", "a ", "alpha", "beta", "▁alpha"]
    monkeypatch.setattr(c, "rows", lambda chunks: [[c.id["▁"]] for _ in chunks])
    with pytest.raises(ValueError, match="differ"):
        c.encoded(["gamma"])


def test_pieces_on_odd_rows(spark, odd, empty, codec):
    docs, df = odd
    got = pieces.encoded(df, queries.public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == df.count()
    assert all(r.decoded == codec.library.decode(codec.library.encode(docs[r.doc_id] or "")) for r in got if r.doc_id is not None)
    assert pieces.digests(empty, queries.public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# 5 media


def check_media(rows, docs):
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        png = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())


def test_op5(spark, documents):
    rows = queries.op5_media_columns(spark, DIR).collect()
    assert len(rows) == len(documents)
    check_media(rows, documents)


def test_media_on_odd_rows(spark, odd, empty, tmp_path):
    docs, df = odd
    root = f"file://{tmp_path}/m"
    assert media.write_archives(df, root, archive_bytes=20_000) == df.count()
    assert media.write_archives(df, root, archive_bytes=20_000) == df.count()  # running again replaces the same archives
    got = media.features(media.members(spark, root, rangebytes=5000)).collect()
    assert len(got) == df.count() and media.members(spark, root, rangebytes=5000).rdd.getNumPartitions() > 3
    check_media([r for r in got if r.doc_id is not None], docs)
    assert media.stored(empty).count() == 0


def test_members_are_retried_alone(tmp_path):
    import zipfile

    from pyarrow import fs

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/1.png", b"one" * 50)
        z.writestr("1/2.png", b"two" * 50)
    infos = zipfile.ZipFile(tmp_path / "a.zip").infolist()

    class Flaky:
        fails = 2

        def open_input_file(self, path):
            if self.fails:
                self.fails -= 1
                raise OSError("lost")
            return fs.LocalFileSystem().open_input_file(path)

    assert media.read_member(Flaky(), str(tmp_path / "a.zip"), infos[1], pause=0) == b"two" * 50
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[infos[0].header_offset + 40] ^= 1
    (tmp_path / "a.zip").write_bytes(raw)
    with pytest.raises(OSError):
        media.read_member(fs.LocalFileSystem(), str(tmp_path / "a.zip"), infos[0], pause=0)
    assert media.read_member(fs.LocalFileSystem(), str(tmp_path / "a.zip"), infos[1], pause=0) == b"two" * 50


def test_folders_of_archives(spark, odd):
    from ruleloom.llm.common import shared_dir

    with pytest.raises(ValueError):
        media._at("dbfs:/somewhere")
    root = Path(shared_dir(spark).removeprefix("file://"))
    before = set(root.glob("media-*"))
    assert media.digests(odd[1]).count() == odd[1].count()
    assert set(root.glob("media-*")) == before


# 6 near duplicates


def check_near(rows, docs, size):
    want = near_duplicates(docs, size)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_op6(spark, documents):
    rows = queries.op6_minhash_dedup(spark, DIR).collect()
    assert len(rows) == len(documents)
    check_near(rows, documents, 4)


@pytest.mark.parametrize("size,block", [(4, 256), (5, 8)])
def test_near_duplicates_on_odd_rows(spark, odd, empty, size, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)  # small blocks split the bucket of near copies
    docs, df = odd
    rows = neardup.near_duplicates(df, size).collect()
    assert len(rows) == df.count()
    check_near([r for r in rows if r.doc_id is not None], docs, size)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(empty, size).count() == 0


def test_one_text_stands_for_an_id(spark):
    a, b = prose(80), prose(80)
    texts = [(1, a), (2, b), (2, edited(a, 1)), (3, edited(b, 1))]
    low = min(neardup._named(neardup.shingles(t, 4))[0] for i, t in texts if i == 2)
    stands = next(t for i, t in texts if i == 2 and neardup._named(neardup.shingles(t, 4))[0] == low)
    want = near_duplicates({1: a, 2: stands, 3: texts[3][1]}, 4)
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()}
    assert got == {(i, c) for i, (_, c) in want.items()} | {(2, 2)}


def test_rows_are_judged_one_by_one(spark):
    a, b = prose(80), prose(80)
    rows = [(1, a, "x"), (2, edited(a, 1), "x"), (2, b, "y"), (3, b, "z"), (4, prose(60), "x"), (4, "", "y"), (4, None, "z"), (None, a, "x"), (5, " ".join(["once", a]), "h0")]
    rows += [rows[4]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, h0 string")
    got = sorted(((r.doc_id, r.text, r.h0) for r in neardup.deduped(df).collect()), key=str)
    # the text that does not stand for 2 stays unless another id holds its set
    copy_stands = neardup._named(neardup.shingles(rows[1][1], 5))[0] < neardup._named(neardup.shingles(b, 5))[0]
    want = [rows[0], *rows[4:8], *([rows[3]] if copy_stands else rows[1:3])]
    assert got == sorted(want, key=str)
    assert neardup.deduped(df).columns == df.columns
    assert neardup.deduped(df.where("false")).count() == 0


def test_open_buckets_send_each_sketch_to_few_blocks(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("id as doc_id", "1L as key", "id as component", f"{n}L as n", "1L as most", "0L as major", "100L as n_shingles")
    sent = neardup._dealt(rows, light=True)
    assert sent.count() <= 2 * neardup.SPREAD * n
    assert sent.groupBy("key", "i", "j", "side").count().agg(F.max("count")).first()[0] <= 2 * n / neardup.SPREAD


def test_open_buckets_lose_no_link(spark):
    """Templates: all texts share most words (0.6 alike, unlinked), some of them are linked in pairs; bands are shared by all."""
    r = random.Random(3)
    words = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    shared = words(75)
    docs = {}
    for i in range(0, 600, 2):
        own = words(25)
        docs[i] = " ".join(shared + own)
        docs[i + 1] = " ".join(shared + own[:-1] + words(1)) if i % 20 == 0 else " ".join(shared + words(25))
    got = neardup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 4).collect()
    check_near(got, docs, 4)


def test_odd_sketches_estimate_similarity():
    one = neardup.shingles(prose(2000), 4)
    for share in (0.9, 0.8):
        n = int(len(one) * share)
        other = np.unique(np.concatenate([one[:n], neardup.shingles(prose(2000), 4)[: len(one) - n]]))
        j = len(np.intersect1d(one, other)) / len(np.union1d(one, other))
        bits = int(np.bitwise_count(neardup.signature(one)[1].view(np.uint64) ^ neardup.signature(other)[1].view(np.uint64)).sum())
        m = neardup.SKETCH_WORDS * 64
        differing = np.log(1 - 2 * bits / m) / np.log(1 - 2 / m) / 2
        assert abs(1 - differing / neardup.HASHES - j) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(300, 299), (299, 300), (7, 7)]
    got = {r.node: r.component for r in components.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components.components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


# 7 repeats


def check_repeats(rows, docs, length=100):
    want = repeats(docs, length)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_op7(spark, documents):
    rows = queries.op7_suffix_dedup(spark, DIR).collect()
    assert len(rows) == len(documents)
    check_repeats(rows, documents)


def test_colliding_hashes_remove_nothing(spark):
    """Two texts without a common string of 100 bytes whose blocks differ by Thue-Morse parity: polynomial hashes modulo
    2**64 of such texts are equal whatever the base."""
    gram = "".join(R.choice("abcdefghijklmnopqrstuvw") for _ in range(32))
    one, other = "", ""
    for k in range(128):
        block, odd_bits = gram + "".join(R.choice("abcdefghijklmnopqrstuvw") for _ in range(31)), k.bit_count() & 1
        one, other = one + block + "xy"[odd_bits], other + block + "yx"[odd_bits]
    docs = {1: one, 2: other}
    assert all(v[1] == 0 for v in repeats(docs, 100).values())
    for hot in (suffix.HOT, 3):
        got = suffix.digests(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), hot=hot).collect()
        assert [r.n_removed for r in got] == [0, 0]
        check_repeats(got, docs)


def test_a_sort_with_colliding_hashes_is_done_again(monkeypatch):
    data = np.frombuffer(bytes(R.choice(b"ab") for _ in range(600)), np.uint8)
    at, size, group = np.arange(500), np.full(500, 60), np.zeros(500, np.int64)
    want = suffix.Sorted(data, at, size, group)
    want_common = want.neighbours()
    tries, made = [], suffix.Sorted.__init__

    def init(self, *args):
        tries.append(args[-1])
        made(self, *args)

    monkeypatch.setattr(suffix.Wrapped, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    monkeypatch.setattr(suffix.Sorted, "__init__", init)
    got, common = suffix._in_order(data, at, size, group)
    assert tries == [0, 1] and (got.order == want.order).all() and (common == want_common).all()


@pytest.mark.parametrize("hot,part", [(suffix.HOT, 1 << 18), (3, 3000)])
def test_repeats_on_odd_rows(spark, odd, empty, hot, part, monkeypatch):
    """Also with names that count as hot and documents that are taken in parts."""
    docs, df = odd
    scratch = Scratch(spark, "t")
    monkeypatch.setattr(suffix, "PART", part)
    found = {r.doc_id: suffix.runs(r["at"]) for r in suffix.repeats(df.select("doc_id", "text"), hot=hot, scratch=scratch).collect()}
    want = repeats(docs, 100)
    assert None not in found
    for i, t in docs.items():
        raw = (t or "").encode()
        assert hashlib.sha256(suffix.without(raw, found.get(i, []))).hexdigest() == want[i][3], i
    assert suffix.digests(empty).count() == 0
    rows = suffix.digests(df).collect()
    assert len(rows) == df.count()
    check_repeats([r for r in rows if r.doc_id is not None], docs)
    assert [r.n_removed for r in rows if r.doc_id is None] == [0]


def test_cleaned_texts_keep_whole_characters(spark):
    passage = "".join(chr(0xE0 + i) for i in range(31)) + "".join(chr(0x400 + i) for i in range(60))
    df = spark.createDataFrame([(1, "a" + passage + "b", 5), (2, "xx" + passage + "漢字", 6), (3, None, 7)], "doc_id long, text string, lang long")
    got = {r.doc_id: r.text for r in suffix.cleaned(df).collect()}
    assert got == {1: "a" + passage + "b", 2: "xx漢字", 3: None}


def test_suffix_order():
    data = np.frombuffer(bytes(R.choice(b"ab") for _ in range(3000)), np.uint8)
    at = np.arange(2000)
    size = np.array([R.randrange(0, 60) for _ in at])
    group = np.array([R.randrange(0, 4) for _ in at])
    s = suffix.Sorted(data, at, size, group)
    raw = data.tobytes()
    keys = [(group[i], raw[at[i] : at[i] + size[i]]) for i in s.order]
    assert keys == sorted(keys)
    for k, n in enumerate(s.neighbours()):
        x, y = (keys[k - 1], keys[k]) if k else ((-1, b""), keys[0])
        common = 0
        while x[0] == y[0] and common < min(len(x[1]), len(y[1])) and x[1][common] == y[1][common]:
            common += 1
        assert n == common


# 8 packing, 9 token counts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(rows, ids, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        whole = np.array([*ids[i], 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(whole)
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    sizes = []
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        sizes.append(at)
    return sizes


def test_op8(spark, documents, tokenizer):
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in documents.items()}
    sizes = check_pieces(queries.op8_packing(spark, DIR).collect(), ids)
    assert sum(2048 - s for s in sizes) <= 2048


def test_ranks_give_the_ids_of_the_tokenizers_library(tokenizer):
    enc = tokens.encoding(tokens.vocabulary_file())
    texts = [t or "" for _, t, *_ in odd_rows()] + ["<|endoftext|> x", "a <|endoftext|>  <|endoftext|><|endoftext|>\n b", "<|endoftext|", " \n<|endoftext|>\n\n  x", "don't<|endoftext|>'t", "don't  stop\n\n1234   x"]
    for t in texts:
        assert tokens.ids_of(enc, t) == tokenizer.encode(t, add_special_tokens=False).ids
    assert tokens.ids_of(enc, "<|endoftext|> x") == [50256, 2124]


def test_ids_of_very_long_texts(tokenizer):
    """Runs of blanks of a million characters are beyond the ranks library's own expressions."""
    enc = tokens.encoding(tokens.vocabulary_file())
    blanks = lambda n: "x" + " " * n + "y <|endoftext|>" + "\n" * 1000 + "z" * 50_000
    with pytest.raises(ValueError):
        enc.encode(blanks(1_000_000), allowed_special="all")
    short, long = (tokens.ids_of(enc, blanks(n)) for n in (1000, 1_000_000))
    assert short == tokenizer.encode(blanks(1000), add_special_tokens=False).ids
    assert long == [short[0], *tokens.ids_of(enc, " ") * 999_000, *short[1:]]


def test_packing_on_odd_rows(spark, odd, empty, tokenizer):
    docs, df = odd
    df = df.where("doc_id is not null and doc_id <> 20")
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in docs.items() if i != 20}
    check_pieces(packing.packed(df, pool=16).collect(), ids)
    assert packing.packed(empty).count() == 0
    assert packing.packed(odd[1]).where("doc_id = 20").agg(F.sum("length")).first()[0] == 2 * (len(tokenizer.encode(docs[20], add_special_tokens=False).ids) + 1)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_padding_of_many_partitions(spark, parts):
    """Less than one window for each partition and pool, and little more where the count rises."""
    docs = spark.createDataFrame([(i, prose(R.randrange(1, 900))) for i in range(1500)], "doc_id long, text string").repartition(parts)
    sizes = [r.n for r in packing.packed(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    pools = parts + 1500 // packing.POOL
    assert max(sizes) <= 2048 and sum(2048 - n for n in sizes) < 2048 * (pools * 1.2 + 1)


def test_differencing_balances():
    sizes = [R.randrange(1, 2048) for _ in range(300)]
    for k in (1, 2, 7, 40):
        dealt = packing.differencing(sizes, k)
        sums = np.bincount(dealt, sizes, minlength=k)
        assert len(dealt) == 300 and sums.max() - sums.min() <= max(sizes) / 4
    least = -(-sum(sizes) // 2048)
    assert len(packing.windows(sizes)) == least
    whole = packing.windows(sizes, cut=False)
    assert len(whole) > least  # the count rises whenever a window exceeds the capacity
    own = packing.windows([1500] * 301)
    assert max(sum(x[2] for x in w) for w in own) <= 2048 and len(own) <= -(-301 * 1500 // 2048) + 3
    assert sum(len(w) > 1 for w in own) and sorted(x[0] for w in own for x in w if x[2] == 1500)  # most items stay whole
    assert all(sum(x[2] for x in own) <= 2048 for own in whole) and sorted(x[0] for own in whole for x in own) == list(range(300))
    assert packing.windows([], 10) == [] and packing.windows([3], 10) == [[(0, 0, 3)]]
    with pytest.raises(ValueError):
        packing.windows([11], 10, cut=False)


def test_op9(spark, documents, tokenizer):
    n = np.array([len(tokenizer.encode(t, add_special_tokens=False).ids) for t in documents.values()])
    rows = queries.op9_token_counts(spark, DIR)
    got = rows.collect()
    assert sum(r.n_docs for r in got) == len(n) and {r.n_tokens for r in got} == set(n.tolist())
    for r in got:
        assert (r.n_docs, r.docs_ge, r.tokens_ge, r.truncated_tokens) == ((n == r.n_tokens).sum(), (n >= r.n_tokens).sum(), n[n >= r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())
        assert abs(r.quantile - (n <= r.n_tokens).mean()) < 1e-9
    for r in lengths.at_limits(rows, [0, 10, 512, 10**6]).collect():
        assert (r.tokens, r.truncated_tokens, r.cut_docs) == (n.sum(), np.minimum(n, r.limit).sum(), (n > r.limit).sum())


def test_token_counts_on_odd_rows(spark, odd, empty):
    assert lengths.histogram(odd[1]).agg(F.sum("n_docs")).first()[0] == odd[1].count()
    assert lengths.suffix_sums(lengths.histogram(empty)).count() == 0
    assert lengths.at_limits(lengths.suffix_sums(lengths.histogram(empty)), [5]).first().tokens == 0


# 10 embeddings


def brute_links(rows):
    ok = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and v is not None and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [(a, b) for x, (a, u, k) in enumerate(ok) for b, v, m in ok[x + 1 :] if k == m and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98]


def check_vectors(got, rows, recall=0.9):
    links = brute_links(rows)
    n, top = {}, {i: i for i, *_ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
        top[max(find(a), find(b))] = min(find(a), find(b))
    assert all(r.n_links <= n.get(r.vec_id, 0) for r in got)
    assert sum(r.n_links for r in got) >= recall * 2 * len(links)
    if sum(r.n_links for r in got) == 2 * len(links):
        assert all(r.component_id == (find(r.vec_id) if r.vec_id is not None else None) for r in got)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_op10(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    check_vectors(queries.op10_embedding_dedup(spark, DIR).collect(), rows)


@pytest.mark.parametrize("block", [512, 16])
def test_vectors_on_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", block)
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 64))
    rows = [(i, None, None) for i in range(2)]
    rows = [(0, None, 1), (1, [0.0] * 64, 1), (2, [1.0, None], 1), (3, [float("nan")] + [1.0] * 63, 1), (4, [float("inf")] + [1.0] * 63, 1), (5, centres[0].tolist(), None), (6, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (8, [1e-30] * 64, 2), (9, [1e30] * 64, 2)]
    rows += [(100 + i, (centres[i % 30] + r.normal(size=64) * r.uniform(0, 0.25)).tolist(), i % 2) for i in range(300)]
    rows += [(500 + i, (centres[0] + r.normal(size=64) * 0.05).tolist(), 0) for i in range(80)]
    rows += [(700 + i, centres[3].tolist(), 1) for i in range(40)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    df = spark.createDataFrame([(*x, 1) for x in rows] + [(None, [1.0] * 64, 2, 1)], "vec_id long, embedding array<float>, label int, kept int").repartition(3)
    got = embed.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    check_vectors([x for x in got if x.vec_id is not None], rows, 0.99)
    assert [(x.n_links, x.component_id, x.kept) for x in got if x.vec_id is None] == [(0, None, True)]
    assert embed.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("dim", [8, 16, 32, 64, 256, 384, 768])
def test_pairs_meet_in_any_dimension(dim):
    r = np.random.default_rng(5)
    u, w = r.normal(size=(2, 2000, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (u * w).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    label = np.zeros(2000, np.int64)
    a, b = embed.cells(u, label), embed.cells(0.98 * u + np.sqrt(1 - 0.98**2) * w, label)
    meets = (a == b[:, :, :1]).any((1, 2)) | (b == a[:, :, :1]).any((1, 2))
    assert meets.mean() > 0.99


@pytest.mark.parametrize("dim", [64, 384, 768])
def test_cells_of_random_vectors_stay_small(dim):
    """Of 20 000 vectors that are not alike, no own cell holds more than a few."""
    u = np.random.default_rng(6).normal(size=(20_000, dim))
    own = np.concatenate([embed.cells(x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x), np.int64))[:, :, 0] for x in np.array_split(u, 20)])
    assert max(np.unique(own[:, t], return_counts=True)[1].max() for t in range(embed.TABLES)) <= 40


def test_lattice_decoding_is_nearest():
    y = np.random.default_rng(1).normal(size=(300, 8)) * 2
    p = embed.decoded(y)
    best = ((y - p) ** 2).sum(1)
    for v in embed._neighbours():
        assert (((y - p - v) ** 2).sum(1) >= best - 1e-9).all()
    whole = np.abs(p - np.rint(p)).max(1) < 1e-9
    assert ((p * 2).sum(1) % 4 < 1e-9).all() and (whole | (np.abs(p - np.floor(p) - 0.5) < 1e-9).all(1)).all()
