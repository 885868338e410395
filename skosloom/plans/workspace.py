"""Shared-storage cuts of long lineages.

Iterative operators write each round as a Parquet table below the folder the
session names in ``spark.checkpoint.dir`` and read it back, so that a lost
executor costs a re-read and never a recomputation of all rounds.  Where the
setting is missing a local session gets a local folder; on a cluster that is an
error, as executors could not read each other's files.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for cuts: ``spark.checkpoint.dir``; a local one only where that is unset and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = "file://" + tempfile.mkdtemp(prefix="skosloom-")
    return _LOCAL["root"]


class Workspace:
    """A private folder of written tables; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop)

    def cut(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return it read back, with its lineage gone."""
        self._n += 1
        at = f"{self.path}/{self._n}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._skosloom_at = at
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Union of tables written by ``cut`` with one schema, as a single scan that packs small files together."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._skosloom_at for t in tables])

    def drop(self, df: DataFrame | None = None) -> None:
        """Delete one written table, or all of them (also done at exit)."""
        at = self.path if df is None else getattr(df, "_skosloom_at", None)
        if at is None:
            return
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended before the exit hook
            pass
