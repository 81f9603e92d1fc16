"""Generations scored as they arrive: each file is scored once, and a restart goes on where the last run stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairscope.functions import text as T
from pairscope.operators import review as R


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def scored(generations: DataFrame) -> DataFrame:
    """Stateless scoring, the same expressions as in batch."""
    rows = generations.withColumn("reference_first_line", T.first_line(F.col("reference_answer")))
    return R.scored(rows, "reference_first_line", "generated_text", F.col("condition").isin("multimodal_conflict", "text_only_conflict"))


def score_folder(spark: SparkSession, folder: str, schema: str, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends scored records to output; with once, takes what is there and ends."""
    writer = scored(arriving(spark, folder, schema)).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
