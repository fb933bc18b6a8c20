"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir.

    Only a local master without that setting gets a folder of its own; on a cluster the setting is required, since a
    folder on one machine is invisible to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def saved(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there and nothing is computed twice.

    batch_rows: rows that go to Python at a time in this job. A batch of whole texts stands in memory several times, in the
    JVM and in the worker, and by default it has 10,000 of them.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark), spark.conf.get(_BATCH_ROWS, None)
    if batch_rows:
        spark.conf.set(_BATCH_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(_BATCH_ROWS, before) if before else spark.conf.unset(_BATCH_ROWS)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """Flat files in a shared folder, written and read by tasks. A local path is memory-mapped, any other read by range."""

    def __init__(self, uri: str):
        self.uri = uri

    def _local(self) -> str | None:
        if "://" not in self.uri:
            return re.sub(r"^file:/*", "/", self.uri)
        return re.sub(r"^file:/+", "/", self.uri) if self.uri.startswith("file:") else None

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def writer(self, name: str):
        """An open binary file. A name is final only after publish()."""
        if local := self._local():
            os.makedirs(local, exist_ok=True)
            return open(f"{local}/{name}", "wb")
        system, path = self._remote()
        system.create_dir(path, recursive=True)
        return system.open_output_stream(f"{path}/{name}")

    def publish(self, name: str, final: str) -> None:
        """Renames, replacing what an earlier attempt of the same task has left: its content is the same."""
        if local := self._local():
            os.replace(f"{local}/{name}", f"{local}/{final}")
            return
        system, path = self._remote()
        if system.get_file_info(f"{path}/{final}").is_file:
            system.delete_file(f"{path}/{final}")
        system.move(f"{path}/{name}", f"{path}/{final}")

    def mapped(self, name: str, dtype: str):
        """The file as an array: memory-mapped where it is local, else read whole."""
        import numpy as np

        if local := self._local():
            return np.memmap(f"{local}/{name}", dtype=dtype, mode="r") if os.path.getsize(f"{local}/{name}") else np.zeros(0, dtype)
        system, path = self._remote()
        with system.open_input_file(f"{path}/{name}") as file:
            return np.frombuffer(file.read(), dtype=dtype)
