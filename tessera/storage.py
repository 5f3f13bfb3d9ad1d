"""Tables that cut lineage, in the folder which driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset in a local session (tests), a temporary folder. A cluster must name one: its executors share no local folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc._jsc.sc().conf().set("spark.checkpoint.dir", root)
        sc.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside go when it ends; a DataFrame that is run again afterwards makes them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables of one run of an operator in the shared folder; they cut lineage and survive lost executors.

    The shuffle files of a table go as soon as it is written. What isn't dropped before goes with the session.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark).rstrip('/')}/tessera/{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.drop)

    def put(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        with cleaned(self.spark):
            df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, or all."""
        try:
            jvm = self.spark.sparkContext._jvm
            for p in [t.scratch_path for t in tables] or [self.root]:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder goes with it
            if tables:
                raise
