"""Labelled rows for fitting: the held-out rule and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id is never held out and never labelled."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text binary, y int): about ``bound`` labelled documents at most, none of them held out.

    The bound applies to the fit only. The rows are those whose hashed id falls under a threshold
    set from the count of labelled rows, so the sample is the same in every run. Conflicting labels of
    an id give the more frequent one; equal texts count once, so that copies carry no weight.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    ids = ids.where(~held_out(F.col("id")))
    n = ids.count()
    share = min(1.0, bound / n) if n else 0.0
    ids = ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    ids = ids.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = texts.join(F.broadcast(ids), "id")  # at most about ``bound`` ids
    return found.groupBy(F.sha2("text", 256).alias("same")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")
