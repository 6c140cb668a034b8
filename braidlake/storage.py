"""Files of the engine: Parquet data and JSON metadata in any file system that Hadoop can reach."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    """Small metadata files by Hadoop's FileSystem, on the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._spark, self._jvm = spark, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"
        if self._local:
            self._fs = self._fs.getRaw()  # no checksum files beside the metadata, which a rename would leave behind

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Writes aside and renames over an older file: readers see the whole old file or the whole new one."""
        part = self._aside(name, value)
        if self._local:
            done = self._fs.rename(part, self._path(name))
        else:
            kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
            over = self._spark.sparkContext._gateway.new_array(kinds, 1)
            over[0] = kinds.OVERWRITE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf).rename(part, self._path(name), over)
            done = True
        if not done:
            raise OSError(f"could not write {name}")

    def create(self, name: str, value: dict) -> bool:
        """Writes a file only if there is none of the name; false if there is. The whole file is written aside and then gets its
        name in one step that never overwrites: a hard link on a local disk, elsewhere a rename, which file systems with atomic
        renames refuse if the name is taken. So no reader sees half a file and a crash leaves at most one under another name."""
        if self.exists(name):
            return False
        part = self._aside(name, value)
        try:
            if not self._local:
                return bool(self._fs.rename(part, self._path(name)))
            where = self._jvm.java.nio.file.Path.of
            none = self._spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)
            try:
                self._jvm.java.nio.file.Files.createLink(where(self._path(name).toUri().getPath(), none), where(part.toUri().getPath(), none))
                return True
            except Exception as e:  # py4j wraps FileAlreadyExistsException
                if "AlreadyExists" in str(e):
                    return False
                raise
        finally:
            if self._fs.exists(part):
                self._fs.delete(part, False)

    def _aside(self, name: str, value: dict):
        part = self._path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, False)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        return part

    def age_ms(self, name: str) -> int:
        """Milliseconds since a file or folder was last changed, by this machine's clock."""
        return int(time.time() * 1000) - self._fs.getFileStatus(self._path(name)).getModificationTime()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or the session's checkpoint folder. Where neither is set, a local master gets a temporary one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = found or (held.get() if held.isDefined() else None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="braidlake-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/braidlake/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
