"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import bound_batches, scratch, shared_folder, spread, written  # noqa: F401  for the operators

def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def again(df: DataFrame) -> DataFrame:
    """A table made by ``written``, read anew: for joins of a table with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._tradeloom_path)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def computed(df: DataFrame, id_col: str, text_col: str, compute: Callable[[list], dict], fields: dict[str, str]) -> DataFrame:
    """``id_col`` as it is, and ``fields`` (name to type) computed from lists of texts, an Arrow batch at a time."""
    bound_batches(df.sparkSession)
    slim = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")))
    names = ["id", *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = compute(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[k], type=ARROW[v]) for k, v in fields.items())], names=names)

    schema = f"id {slim.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in fields.items())
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def kept_where(df: DataFrame, text_col: str, keep: Callable[[list], list]) -> DataFrame:
    """The rows, whole, whose text ``keep`` accepts; it gets lists of texts and gives booleans."""
    bound_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_tradeloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def in_fold(column: str, folds: int, held_out: int):
    """True where crc32 of the id as text falls in the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == held_out, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of the links ``(a, b)``: one row ``(node, component)`` per node that has a link.

    The component is the smallest node id in it. Alternates large-star and small-star steps, which shrink every component to a star
    in about log n rounds. Each step is an aggregation (combined on the map side, so a hub is no hot spot) and an equi-join, which
    adaptive execution splits where a hub holds many rows. Each round's links are written to the shared folder. Empty links give an empty
    result.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = written(links, "links")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(links)
    for _ in range(max_rounds if seen[0] else 0):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.where("m < u").select("u", F.col("m").alias("v"))
        large = large.union(kept).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_written(links)
        links, before, seen = nxt, seen, mark(nxt)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
