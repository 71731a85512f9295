"""Layered tables (bronze / silver / gold) as plain Parquet on a shared file system.

``Lake(root)`` maps ``(layer, table)`` to ``<root>/<layer>/<table>``.  Batch writes replace a table;
streams append through Spark's file sink, whose own log makes readers see whole batches only.

The root must be on storage every executor sees (the cluster's
``spark.checkpoint.dir`` or a lake bucket), never a machine-local folder.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ridepulse.session import freed_shuffles

#: Codec of the tables' Parquet files, in batch and on streams.
COMPRESSION = "zstd"


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, layer: str, table: str) -> str:
        return posixpath.join(self.root, layer, table)

    # -- Hadoop file system --------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def make_dir(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def read_text(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """A small file in one step: written under another name, then renamed (the first one to do so wins)."""
        fs, p = self._fs(path)
        tmp = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        fs.rename(tmp, p)

    # -- tables ------------------------------------------------------------------------
    def write_overwrite(self, df: DataFrame, layer: str, table: str, partition_by: list[str] | None = None) -> None:
        """Replace a table (with ``partition_by``: by Hive-style partitions)."""
        w = df.write.mode("overwrite").option("compression", COMPRESSION)
        with freed_shuffles(self.spark):
            (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path(layer, table))

    def read(self, layer: str, table: str, schema: StructType | None = None) -> DataFrame:
        """A table; with a schema, one that a stream has not written to yet is empty."""
        if schema is None:
            return self.spark.read.parquet(self.path(layer, table))
        self.make_dir(self.path(layer, table))
        return self.spark.read.schema(schema).parquet(self.path(layer, table))
