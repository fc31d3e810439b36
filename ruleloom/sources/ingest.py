"""Inputs of rules: exact numbers from floating ones, lists from child tables, documents from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact(df: DataFrame, decimals: dict[str, tuple[int, int]], tolerance: float | None = 1e-6) -> DataFrame:
    """DOUBLE columns as DECIMAL(precision, scale). A value further than the tolerance from its decimal is refused."""
    cols = {}
    for name, (p, s) in decimals.items():
        d = F.col(name).try_cast(f"decimal({p},{s})")
        if tolerance is not None:
            off = (F.col(name).isNotNull() & d.isNull()) | (F.abs(F.col(name).cast("double") - d.cast("double")) > tolerance)
            d = F.when(off, F.raise_error(F.concat(F.lit(f"E_NOT_NUM: {name} is not a DECIMAL({p},{s}): "), F.col(name).cast("string"))).cast(f"decimal({p},{s})")).otherwise(d)
        cols[name] = d
    return df.withColumns(cols)


def distinct_names(df: DataFrame) -> DataFrame:
    """Refuses schemas in which two names differ in case only: rules name columns without regard to case."""
    seen: dict[str, str] = {}
    for c in df.columns:
        if c.upper() in seen:
            raise ValueError(f"columns {seen[c.upper()]} and {c} differ in case only")
        seen[c.upper()] = c
    return df


def nested(parents: DataFrame, children: DataFrame, on: str, into: str, fields: list[str], order: list[Column | str]) -> DataFrame:
    """Parents with their children as an array of structs, in the given total order; no children is an empty array.

    One parent's children are gathered into its row, so use operators.lifted where they may be many.
    """
    by = [F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)]
    at = {c: f"o{i}" for i, c in enumerate(order) if isinstance(c, str)}  # what orders the rows is not gathered twice
    rows = children.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(*by, *(f for f in fields if f not in at)))).alias("__rows"))
    array = F.transform("__rows", lambda r: F.struct(*(r[at.get(f, f)].alias(f) for f in fields)))
    empty = F.array().cast(T.ArrayType(T.StructType([children.schema[f] for f in fields])))
    return parents.join(rows, on, "left").withColumn(into, F.when(F.col("__rows").isNotNull(), array).otherwise(empty)).drop("__rows")


def from_json(df: DataFrame, column: str, schema: str, into: str = "value") -> DataFrame:
    """JSON documents as typed columns; floating numbers have no place in the schema."""
    if "double" in schema.lower() or "float" in schema.lower():
        raise ValueError("name an exact decimal type")
    return df.withColumn(into, F.from_json(column, schema))


def to_json(df: DataFrame, columns: list[str], into: str = "json") -> DataFrame:
    """Results as one JSON text a row."""
    return df.withColumn(into, F.to_json(F.struct(*columns)))


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: object) -> DataFrame:
    """A table of any format Spark reads; text formats need a schema, so that nothing is inferred from the data."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return distinct_names((reader.schema(schema) if schema else reader).load(path))


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.format(fmt).mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
