import pytest

from ruleloom.sources import ingest


def test_inexact_numbers_are_refused(spark):
    df = spark.createDataFrame([(0.125,)], "a double")
    assert str(ingest.exact(df, {"a": (10, 3)}).first()[0]) == "0.125"
    with pytest.raises(Exception, match="E_NOT_NUM"):
        ingest.exact(df, {"a": (10, 2)}).collect()


def test_names_that_differ_in_case(spark):
    with pytest.raises(ValueError):
        ingest.distinct_names(spark.sql("select 1 as a, 2 as A"))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "ż")], "k long, v string")
    ingest.write(df, str(tmp_path / fmt), fmt)
    got = ingest.read(spark, str(tmp_path / fmt), fmt, "k long, v string" if fmt in ("json", "csv") else None)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "ż")]


def test_json(spark):
    df = spark.createDataFrame([('{"QTY": "2", "N": 1.50}',)], "j string")
    got = ingest.from_json(df, "j", "QTY string, N decimal(10,2)").select("value.*")
    assert ingest.to_json(got, ["QTY", "N"]).first()["json"] == '{"QTY":"2","N":1.50}'
    with pytest.raises(ValueError):
        ingest.from_json(df, "j", "N double")


def test_nested_keeps_parents_without_children(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k long, o int, v string")
    got = {r.k: [x.v for x in r.xs] for r in ingest.nested(p, c, "k", "xs", ["v"], ["o"]).collect()}
    assert got == {1: ["a", "b"], 2: []}
