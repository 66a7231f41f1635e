"""Resumable ingestion: new files of a landing folder are taken in once, keys that are known are left out.

A query with a checkpoint remembers the files it has read; an anti join with the target leaves out keys that arrived before
in another file. A batch that ran twice after a failure writes nothing the second time, since its keys are known then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException


#: Name of the observation of a batch.
COUNTS = "ingested"


def _known(spark: SparkSession, target: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: The target is kept in so many folders by a hash of the key; a batch reads the keys of those that it touches.
BUCKETS = 256


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: str, key: str, order: str) -> StreamingQuery:
    """Appends the rows of new JSON Lines files to the Parquet table `target`; of equal keys the first by `order` stays. Rows without a key are dropped.

    The counts of each batch (rows read, rows with a key, new rows) are taken on the way by an observation, COUNTS.
    """
    stream = spark.readStream.schema(schema).json(landing)

    def write(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        placed = batch.observe(COUNTS, F.count("*").alias("read"), F.count(key).alias("keyed")).where(F.col(key).isNotNull())
        placed = placed.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int"))
        first = placed.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")
        touched = [r[0] for r in placed.select("_bucket").distinct().collect()]  # at most BUCKETS
        known = _known(own, target, first.schema).where(F.col("_bucket").isin(touched)).select("_bucket", key)
        first.join(known, ["_bucket", key], "left_anti").select(*batch.columns, "_bucket").write.mode("append").partitionBy("_bucket").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) of tumbling windows; rows later than the watermark are left out by the stream, a batch counts all."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
