"""Move a DataFrame's plan into another session of the same context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def adopt(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a DataFrame of ``spark``: temporary views of one session are unknown to the others."""
    if df.sparkSession is spark:
        return df
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
