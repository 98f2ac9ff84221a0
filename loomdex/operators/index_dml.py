"""Changes of the page index: partial upsert, touch, delete and change detection, as joins on the URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PAGE


def empty_index(spark) -> DataFrame:  # noqa: ANN001
    """An index without pages, with the explicit schema."""
    return spark.createDataFrame([], PAGE)


def one_per_url(batch: DataFrame, newest: str) -> DataFrame:
    """The newest row of each URL, by a struct maximum (partial aggregation, no sort)."""
    rest = [c for c in batch.columns if c not in ("url", newest)]
    best = batch.groupBy("url").agg(F.max(F.struct(newest, *rest)).alias("_r"))
    return best.select("url", *[F.col(f"_r.{c}").alias(c) for c in batch.columns if c != "url"])


def _merge(kind: T.DataType, new: Column, old: Column) -> Column:
    if isinstance(kind, T.StructType):
        merged = F.struct(*[_merge(f.dataType, new[f.name], old[f.name]).alias(f.name) for f in kind.fields])
        return F.when(new.isNotNull() | old.isNotNull(), merged)
    return F.coalesce(new, old)


def upsert(index: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """``index`` with ``batch`` (one row per URL, any subset of the columns) merged in.

    Present fields overwrite, absent and null ones keep the old value, structs merge field by field, arrays are
    replaced. New and changed rows get ``last_indexed`` and ``updated_at``; ``first_indexed`` is kept or set. Columns
    that the index does not have are dropped.
    """
    o, n = index.alias("o"), batch.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, F.col("o.url") == F.col("n.url"), "full_outer")
    hit = F.col("n._new").isNotNull()
    out = [F.coalesce("n.url", "o.url").alias("url")]
    for f in index.schema.fields:
        c = f.name
        if c == "url":
            continue
        old = F.col(f"o.{c}")
        value = _merge(f.dataType, F.col(f"n.{c}"), old) if c in batch.columns else old
        if c in ("last_indexed", "updated_at"):
            value = F.when(hit, now).otherwise(old)
        elif c == "first_indexed":
            value = F.when(hit, F.coalesce(value, now)).otherwise(old)
        out.append(value.alias(c))
    return joined.select(*out)


def touch(index: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """``index`` with only the times of the listed URLs set; unknown URLs are ignored."""
    t = urls.select(F.col("url").alias("_u")).distinct()
    hit = F.col("_u").isNotNull()
    return index.join(t, index["url"] == F.col("_u"), "left").withColumns(
        {"last_indexed": F.when(hit, now).otherwise(F.col("last_indexed")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    ).drop("_u")


def delete(index: DataFrame, urls: DataFrame) -> DataFrame:
    return index.join(urls.select("url"), "url", "left_anti")


def change_kind(index: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` with ``change``: insert, touch (same content hash) or update."""
    known = index.select(F.col("url").alias("_u"), F.col("content_hash").alias("_h"))
    kind = F.when(F.col("_u").isNull(), "insert").when(F.col("content_hash") == F.col("_h"), "touch").otherwise("update")
    return batch.join(known, batch["url"] == F.col("_u"), "left").withColumn("change", kind).drop("_u", "_h")


def stale(index: DataFrame, now: Column, hours: int, limit: int) -> DataFrame:
    """URLs not indexed for ``hours``, oldest first, at most ``limit`` (a batch of the reindex cycle)."""
    return index.where(F.col("last_indexed") <= now - F.expr(f"INTERVAL {int(hours)} HOURS")).select("url", "last_indexed").orderBy("last_indexed", "url").limit(limit)
