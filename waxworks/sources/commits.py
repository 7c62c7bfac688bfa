"""A log of numbered entries in a shared folder, for writers that don't know of each other."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class CommitLog:
    """Entries 0, 1, 2, ... as one small JSON file each; an entry is put only where none is.

    An entry is written beside the log first and then renamed without overwriting, which is atomic where
    the file system says so (HDFS and the like). Readers see whole entries only. Of two writers of the
    same number one is told to look again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._root = self._hadoop.Path(folder)
        self._fs = self._root.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(self._root).toUri(), conf)

    def _path(self, name: str):
        return self._fs.makeQualified(self._hadoop.Path(self._root, name))

    def last(self) -> int:
        """The highest number in the log, -1 in an empty one."""
        if not self._fs.exists(self._root):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def commit(self, n: int, entry: dict | list[dict]) -> bool:
        """Puts the entry, or a list of them, under ``n``; False if that number is taken."""
        draft, goal = self._path(f".{uuid.uuid4().hex}"), self._path(f"{n:020d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = getattr(self._hadoop, "Options$Rename").NONE
        try:
            self._context.rename(draft, goal, options)
            return True
        except Exception:
            if not self._fs.exists(goal):
                raise
            self._fs.delete(draft, False)
            return False

    def read(self, n: int) -> dict | list[dict]:
        source = self._fs.open(self._path(f"{n:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def state(self) -> tuple[int, dict | list[dict] | None]:
        """Number and content of the last entry."""
        n = self.last()
        return n, self.read(n) if n >= 0 else None

    def entries(self, schema: str) -> DataFrame:
        """All entries as a table."""
        return self.spark.read.schema(schema).json(self.folder)
