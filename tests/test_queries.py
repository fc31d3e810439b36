"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from ruleloom import queries as q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, duck, name):
    got, want = q.QUERIES[name](spark, DIR).toPandas(), duck.sql(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_checksums(spark):
    import zlib

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in q.QUERIES["checksums"](spark, DIR).collect():
        assert (r.crc, r.code) == (f"{zlib.crc32(text[r.doc_id].encode()):08x}", None)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(q.QUERIES) <= set(entry.queries()) and set(q.ORACLES) <= set(entry.oracle_sql())


def test_lifted_errors_equal_nested_errors(spark):
    from pyspark.sql import functions as F

    from ruleloom.functions.terms import captured, num_col
    from ruleloom.operators import lifted, lists
    from ruleloom.sources import ingest

    parents = spark.createDataFrame([(k,) for k in range(5)], "k long")
    kids = spark.createDataFrame([(0, 1, 5), (0, 2, 0), (1, 1, 0), (1, 2, 5), (2, 1, 7), (3, 1, 9), (3, 2, 0), (3, 3, 1)], "k long, o int, v int").withColumn("v", F.col("v").cast("decimal(10,0)"))
    v = num_col("v", 10, 0)
    body = lambda x: 10 / x > 1
    joined, t = lifted.attach(parents, kids, "k", {"all": lifted.all_(body(v), F.col("o")), "any": lifted.any_(body(v), F.col("o")), "sum": lifted.sum_(10 / v, order=F.col("o")), "first": lifted.first(v, F.col("o"), 10)})
    a = joined.select("k", *(captured(x).alias(n) for n, x in t.items())).orderBy("k").collect()
    nested = ingest.nested(parents, kids, "k", "L", ["v"], ["o"])
    xs = lists.list_col("L", lists.records({"v": lambda c: num_col(c, 10, 0)}))
    u = {"all": lists.all_(xs, lambda i, k: body(i["v"])), "any": lists.any_(xs, lambda i, k: body(i["v"])), "sum": lists.sum_(xs, lambda i, k: 10 / i["v"]), "first": xs[1]["v"]}
    b = nested.select("k", *(captured(x).alias(n) for n, x in u.items())).orderBy("k").collect()
    for x, y in zip(a, b, strict=True):
        assert x.asDict(True) == y.asDict(True)


def test_whole_texts(spark, tmp_path):
    """Brute force over texts that differ, and hold bytes of every length, far behind the prefixes of the older queries."""
    import base64
    import zlib

    words = "Zażółć gęślą 👍 jaźń\n"
    text = {1: words * 200, 2: words * 200 + "x", 3: "a" * 300 + "é", 4: "b", 5: "", 6: None, **{10 + n: "\x00ß"[:1] + "é" * n + "z" * n for n in range(1, 16)}}
    spark.createDataFrame(list(text.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: {r.doc_id: r for r in q.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("text_functions", "encodings", "round_trips", "checksums", "bitwise")}
    for n, found in got.items():
        assert set(found) == set(text), n
    for k, t in text.items():
        trips, codes = got["round_trips"][k], [got[n][k].code for n in ("encodings", "checksums")]
        if t is None:
            assert trips[1:4] == (None,) * 3 and trips.list_error == "E_NOT_TEXT" and codes == ["E_NOT_TEXT"] * 2 and got["text_functions"][k].code_error == "E_NOT_TEXT"
            continue
        b, u = t.encode(), t.translate({c: c - 32 for c in range(97, 123)}).encode()
        assert got["text_functions"][k].back == t[::-1] and codes == [None, None]
        assert got["encodings"][k][1:4] == (len(b), b.hex(), base64.b64encode(b).decode())
        assert got["checksums"][k].crc == f"{zlib.crc32(b):08x}"
        assert got["bitwise"][k][1:] == (bytes(x ^ y for x, y in zip(b, u, strict=True)).hex(), bytes(x & y for x, y in zip(b, u, strict=True)).hex(), bytes(x | y for x, y in zip(b, u, strict=True)).hex())
        assert (trips.round_hex, trips.round_b64, trips.round_list, trips.round_xor) == (t, t, t or None, t)
        assert trips.list_error == (None if t else "E_NO_SCALAR")


@pytest.mark.parametrize("name", ["division", "error_capture", "arithmetic", "order_rule_nested"])
def test_plans_stay_small(spark, name):
    """Operands are not repeated through each step of an expression."""
    plan = q.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 14_000 and plan.count("lambdafunction") < 40, (len(plan), plan.count("lambdafunction"))
