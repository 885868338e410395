"""Concept files: tab-separated, UTF-8, with a header and doubled quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skosloom.operators.lexicon import null_tokens
from skosloom.operators.rejects import FIELDS

REQUIRED = ("skos:prefLabel", "skos:definition", "skos:altLabel")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Records of a concept file with ``row_id`` in file order; null tokens become null, ``NA`` stays.

    A missing file fails at once, and so does a header without a required
    column.  All columns are read as text; nothing is inferred.
    """
    header = spark.read.text(path).limit(1).collect()  # raises where the path does not exist
    names = [h.strip().strip('"') for h in header[0][0].split("\t")] if header else []
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "")
    df = null_tokens(reader.csv(path))
    for f in FIELDS:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("string"))
    # order of the files by name, and of the records within: splits are read in the order of their size, so ids alone would follow that
    told = df.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"), *[F.col(f"`{f}`") for f in FIELDS])
    return told.orderBy("_file", "_at").select(F.monotonically_increasing_id().alias("row_id"), *[F.col(f"`{f}`") for f in FIELDS])


def write_tsv(df: DataFrame, path: str, order_by: str | None = None) -> str:
    """Write text columns as tab-separated files with a header; sorted over all files if ``order_by`` is given."""
    out = df.orderBy(F.asc_nulls_last(order_by)) if order_by else df
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    return path
