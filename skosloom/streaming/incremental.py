"""Structured Streaming forms of what can be done record by record.

New concept records are joined to a fixed label index and give explicit and
lexical links; raw records are classified as they arrive; counts of links per
detector are kept in event-time windows with late rows dropped by watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skosloom.functions.text import normalize_text
from skosloom.operators.lexicon import first_labels, null_tokens
from skosloom.operators.rejects import read_records


def classified(raw_stream: DataFrame, raw: str = "raw") -> DataFrame:
    """Records of a stream with ``reason`` (null if valid)."""
    return read_records(raw_stream, raw).withColumnRenamed("_reason", "reason").drop("_raw")


def linked(concept_stream: DataFrame, known: DataFrame) -> DataFrame:
    """Explicit links of new records against the label index of ``known`` prepared concepts (stream–static join)."""
    new = null_tokens(concept_stream).where(F.col("`skos:broader`").isNotNull())
    told = new.select("row_id", F.col("URI").alias("child_uri"), F.explode(F.split("`skos:broader`", "##|, ")).alias("parent"))
    told = told.withColumn("key", normalize_text(F.col("parent"))).where(F.col("key") != "")
    return told.join(first_labels(known), "key", "left").select("row_id", "child_uri", "parent", F.col("first_uri").alias("parent_uri"))


def windowed_counts(link_stream: DataFrame, time: str = "detected_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Links and mean confidence per window and category; rows later than the watermark are dropped."""
    return (
        link_stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, window), "relation_category")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"))
        .select(F.col("window.start").alias("start"), "relation_category", "n", "avg_confidence")
    )


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run all that is there, batch by batch, through ``sink``; the checkpoint folder makes a restart go on."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
