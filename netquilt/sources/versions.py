"""States of a stored table, each a numbered commit that names what belongs to it.

What a commit names is written first, in folders of its own; the commit is one
small file that is moved into place under the next number, which fails if
another writer was there first. So a reader sees a state whole or not at all,
and what a crash leaves behind belongs to none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self.folder = str(self._fs.makeQualified(self._path(self.folder)).toString())

    def latest(self) -> tuple[int, dict]:
        """Number and content of the last commit; 0 and nothing before the first."""
        where = self._path(f"{self.folder}/commits")
        if not self._fs.exists(where):
            return 0, {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(where))
        done = [n for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return (int(done[-1][:-5]), self.at(int(done[-1][:-5]))) if done else (0, {})

    def at(self, number: int) -> dict:
        """Content of a commit."""
        stream = self._fs.open(self._path(self._name(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _name(self, number: int) -> str:
        return f"{self.folder}/commits/{number:012d}.json"

    def fresh(self, kind: str) -> str:
        """A folder for something that the next commit will name."""
        return f"{self.folder}/{kind}/{uuid.uuid4().hex}"

    def commit(self, number: int, state: dict) -> None:
        """Make ``state`` the commit of this number; an error if there is one already."""
        temp = self._path(f"{self.folder}/commits/.{uuid.uuid4().hex}")
        final = self._path(self._name(number))
        out = self._fs.create(temp, True)
        out.write(json.dumps(state).encode())
        out.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(temp, final, none)
        except Exception as failed:
            self._fs.delete(temp, False)
            if self._fs.exists(final):
                raise RuntimeError(f"another writer made version {number} of {self.folder}") from failed
            raise
