"""Rules over streams: a rule set is a projection, so it needs no state; only counting over time does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ruleset import RuleSet


def validated(stream: DataFrame, rules: RuleSet, keep: list[str]) -> DataFrame:
    """One captured result column per rule; rows with errors go on."""
    return rules.apply(stream, "capture", keep)


def counted(stream: DataFrame, rules: RuleSet, ts: str, window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, rule, message, error, n) per event-time window; state is bounded by the watermark."""
    told = rules.messages(stream.withWatermark(ts, late), [ts])
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return told.groupBy(w.alias("w"), "rule", "message", "error").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "rule", "message", "error", "n")


def routed(stream: DataFrame, rules: RuleSet, accept: Callable[[DataFrame, int], None], reject: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Rows that no rule complains about go to accept, the others with their messages to reject. Both get the batch id, so a
    sink that remembers it writes each batch once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        done = batch.select("*", F.struct(*rules.columns("capture")).alias("__told"))
        ok = F.lit(True)
        for n in rules.rules:
            r = F.col("__told")[n]
            ok = ok & r["error"].isNull() & (F.coalesce(r["value"].cast("string"), F.lit("")) == "")
        accept(done.where(ok).drop("__told"), batch_id)
        reject(done.where(~ok).withColumnRenamed("__told", "told"), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
