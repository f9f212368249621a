"""A partitioned table whose partitions are replaced atomically, several at a time.

Every commit writes its partitions into a folder of its own and then renames a small manifest into place, so a
reader sees either all of a commit or nothing of it, and a writer that dies half-way leaves only an orphaned
folder. The manifest has one entry for each live partition (not for each row), in the order of days or buckets.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fs_of


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small file's content, or None where it doesn't exist."""
    fs, at = fs_of(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish_json(spark: SparkSession, path: str, content: dict) -> None:
    """Replace a small file in one step: a reader sees the old content or the new one."""
    fs, final = fs_of(spark, path)
    _, draft = fs_of(spark, f"{path}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(draft, final, options)


class PartitionStore:
    """Rows partitioned by one column of type string or int; a partition is always replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition: str):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition
        self.body = T.StructType([f for f in schema.fields if f.name != partition])

    def manifest(self) -> dict:
        """``{"batch": last committed batch, "parts": {partition value: folder}}``."""
        return read_json(self.spark, f"{self.path}/manifest.json") or {"batch": -1, "parts": {}}

    def read(self, values: list | None = None, manifest: dict | None = None) -> DataFrame:
        """All rows, or those of the partitions in ``values``; the files of other partitions aren't listed."""
        parts = (manifest or self.manifest())["parts"]
        chosen = {v: d for v, d in parts.items() if values is None or v in {str(x) for x in values}}
        kind = self.schema[self.partition].dataType
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        by_folder: dict[str, list[str]] = {}
        for value, folder in chosen.items():
            by_folder.setdefault(folder, []).append(f"{self.path}/{folder}/{self.partition}={value}")
        reader = self.spark.read.schema(self.body)
        paths = [p for group in by_folder.values() for p in group]
        df = reader.parquet(*paths)
        value = F.regexp_extract(F.col("_metadata.file_path"), f"/{self.partition}=([^/]+)/", 1).cast(kind)
        return df.withColumn(self.partition, value).select(*self.schema.names)

    def replace(self, df: DataFrame, values: list, batch: int) -> None:
        """Replace the partitions in ``values`` by the rows of ``df``. A batch that was committed before is ignored."""
        manifest = self.manifest()
        if batch <= manifest["batch"]:
            return
        folder = f"batch={batch}"
        df.select(*self.schema.names).write.mode("overwrite").partitionBy(self.partition).parquet(f"{self.path}/{folder}")
        fs, _ = fs_of(self.spark, self.path)
        for value in map(str, values):
            _, written = fs_of(self.spark, f"{self.path}/{folder}/{self.partition}={value}")
            if fs.exists(written):
                manifest["parts"][value] = folder
            else:
                manifest["parts"].pop(value, None)
        manifest["batch"] = batch
        publish_json(self.spark, f"{self.path}/manifest.json", manifest)
