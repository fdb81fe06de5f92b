"""Coverage of call files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.functions.expr import percent
from methylake.operators.coverage import consistent_calls


def call_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (read_id, meth, chr, pos, call) from five-column call files that are moved into a folder; lines of
    another shape, as header lines, go."""
    f = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.split("value", "\t").alias("f")).where(F.size("f") == 5)
    out = f.select(F.col("f")[0].alias("read_id"), F.col("f")[1].alias("meth"), F.col("f")[2].alias("chr"), F.col("f")[3].try_cast("long").alias("pos"), F.col("f")[4].alias("call"))
    return out.where("pos >= 1")


def running_coverage(calls: DataFrame) -> DataFrame:
    """(chr, pos, m, u, pct) so far, of a stream of calls; the state is two counts a covered position."""
    m, u = F.count_if(F.col("meth") == "+"), F.count_if(F.col("meth") == "-")
    return consistent_calls(calls).groupBy("chr", "pos").agg(m.alias("m"), u.alias("u")).withColumn("pct", percent(F.col("m"), F.col("u")))


def batch_coverage(calls: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each micro-batch's own counts (chr, pos, m, u) below path, in a folder of the batch's
    number, so a batch that is run again replaces what it wrote. No state is kept: coverage_of adds the batches up."""

    def write(batch: DataFrame, number: int) -> None:
        m, u = F.count_if(F.col("meth") == "+"), F.count_if(F.col("meth") == "-")
        counts = consistent_calls(batch).groupBy("chr", "pos").agg(m.alias("m"), u.alias("u"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage_of(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, m, u, pct) of all batches that batch_coverage has written."""
    sums = spark.read.parquet(path).groupBy("chr", "pos").agg(F.sum("m").alias("m"), F.sum("u").alias("u"))
    return sums.withColumn("pct", percent(F.col("m"), F.col("u")))
