import pytest
from pyspark.sql import functions as F

from ruleloom.functions import logic
from ruleloom.functions.terms import num_col, text_col
from ruleloom.plans.ruleset import RuleSet
from ruleloom.sources import ingest
from ruleloom.streaming import monitor

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def rules(spark):
    return RuleSet({"value": logic.if_(num_col("value", 18, 4) < 10, "low", ""), "type": logic.if_(logic.in_(text_col("event_type"), "click"), "", "not a click")})


def _stream(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return ingest.exact(events, {"value": (18, 4)}, None), ingest.exact(stream, {"value": (18, 4)}, None)


def _run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_validated_stream_equals_batch(spark, tmp_path, rules):
    batch, stream = _stream(spark, tmp_path)
    got = _run(spark, monitor.validated(stream, rules, ["event_id"]), "validated", tmp_path)
    assert sorted(map(str, got.collect())) == sorted(map(str, rules.apply(batch, "capture", ["event_id"]).collect()))


def test_counted_stream_equals_batch(spark, tmp_path, rules):
    batch, stream = _stream(spark, tmp_path)
    got = _run(spark, monitor.counted(stream, rules, "ts", "1 day", "400 days"), "counted", tmp_path, "complete")
    want = rules.messages(batch, ["ts"]).groupBy(F.window("ts", "1 day").start.alias("start"), "rule", "message", "error").count()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_routed_stream_splits_rows(spark, tmp_path, rules):
    batch, stream = _stream(spark, tmp_path)
    put = lambda where: lambda df, k: df.write.mode("overwrite").parquet(str(tmp_path / where / f"batch={k}"))
    monitor.routed(stream, rules, put("yes"), put("no"), str(tmp_path / "cp")).awaitTermination()
    n = {w: spark.read.parquet(str(tmp_path / w)).count() for w in ("yes", "no")}
    bad = rules.messages(batch, ["event_id"]).select("event_id").distinct().count()
    assert n == {"yes": batch.count() - bad, "no": bad}
