"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

From the rows (one per distinct length) every total, quantile and truncated total for a context limit follows without
another pass over the texts.

Defined results: null text is empty and has length 0; repeated rows count each time; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_batches, slices, texts_of
from .tokens import encoding, ids_of, vocabulary_file


def histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs), kept as a small table, so the sums over it read the texts once. Each batch is summed in the worker,
    so the shuffle carries distinct lengths, not documents."""
    file = vocabulary or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(file)
        for batch in slices(batches, 2048):
            n, k = np.unique(np.array([len(ids_of(enc, t)) for t in texts_of(batch)], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k.astype(np.int64))], names=["n_tokens", "n_docs"])

    bounded_batches(docs.sparkSession)
    each = docs.selectExpr(f"`{text}` as text").mapInArrow(run, "n_tokens long, n_docs long")
    return Scratch(docs.sparkSession, "lengths").keep(each.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def suffix_sums(hist: DataFrame, width: int = 64) -> DataFrame:
    """Adds docs_ge and tokens_ge (documents of at least this length, and their tokens), truncated_tokens (all tokens when
    every document is cut to this length) and quantile (share of documents of at most this length).

    Sums are made within ranges of ``width`` lengths, then over the ranges' totals, so no task sorts the whole histogram.
    """
    own = hist.withColumn("__range", F.floor(F.col("n_tokens") / width)).withColumn("__t", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = own.groupBy("__range").agg(F.sum("n_docs").alias("d"), F.sum("__t").alias("t"))
    whole = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("__range", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("__d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("__tt"), F.sum("d").over(whole).alias("__all"), F.sum("t").over(whole).alias("__tokens"))
    w = Window.partitionBy("__range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    got = own.join(ranges, "__range").withColumn("docs_ge", F.sum("n_docs").over(w) + F.col("__d")).withColumn("tokens_ge", F.sum("__t").over(w) + F.col("__tt"))
    below = F.col("__tokens") - F.col("tokens_ge")
    return got.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        (below + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_tokens"),
        (F.lit(1.0) - (F.col("docs_ge") - F.col("n_docs")) / F.col("__all")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, total, truncated total, documents cut) for each limit, from the suffix sums alone."""
    spark = sums.sparkSession
    wanted = F.array(*(F.lit(x).cast("long") for x in limits))
    rows = sums.select(F.explode(wanted).alias("limit"), "*")
    got = rows.groupBy("limit").agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_tokens"), F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("cut_docs"))
    return spark.createDataFrame([(x,) for x in limits], "limit long").join(got, "limit", "left").na.fill(0)
