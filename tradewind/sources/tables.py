"""Tables of immutable versions: data is written beside, a commit file makes it current.

A table is a folder with data/ (a folder a write, never changed) and commits/ (a JSON file a
version, named by its number). A commit is put under its name only if the name is free, by a
rename that doesn't overwrite, so of two writers of one version one loses and nothing is half
there. Readers list the commits, take the last, and read the folders that it names; older
folders stay until they are vacuumed, so a reader that has begun is never cut off.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"(\d{20})\.json$")


class Conflict(Exception):
    """Another writer has made the version that this one was to be."""


class Table:
    """A versioned table at path. Its schema is the last commit's; a table without commits has no rows to read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(hadoop.Path(f"{self.path}/commits"))

    def versions(self) -> list[int]:
        found = (_NAME.search(s.getPath().getName()) for s in self._fs.listStatus(self._at(f"{self.path}/commits")))
        return sorted(int(m[1]) for m in found if m)

    def commit(self, version: int) -> dict:
        """What a version's commit says: folders, schema, and the writer's notes."""
        stream = self._fs.open(self._at(f"{self.path}/commits/{version:020d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        """(last version, its commit); (0, no folders) of a table without commits."""
        last = max(self.versions(), default=0)
        return last, self.commit(last) if last else {"folders": [], "schema": None, "notes": {}}

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        last, commit = self.current() if version is None else (version, self.commit(version))
        if not commit["schema"]:
            if schema is None:
                raise ValueError(f"{self.path} has no version")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(commit["schema"])
        folders = [f"{self.path}/data/{f}" for f in commit["folders"]]
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], commit["schema"])

    def stage(self, df: DataFrame, by: Sequence[str] = ()) -> str:
        """Write df to a folder that no commit names yet; its name."""
        folder = uuid.uuid4().hex
        w = df.write.partitionBy(*by) if by else df.write
        w.parquet(f"{self.path}/data/{folder}")
        return folder

    def put(self, version: int, folders: Sequence[str], schema: str, notes: dict | None = None) -> None:
        """Make folders the rows of a version, if nobody has made it yet."""
        text = json.dumps({"folders": list(folders), "schema": schema, "notes": notes or {}}, sort_keys=True).encode()
        temp = self._at(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(text))
        out.close()
        jvm = self.spark._jvm
        none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(temp, self._at(f"{self.path}/commits/{version:020d}.json"), none)
        except Py4JJavaError as e:
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} of {self.path} is there") from None
            raise

    def replace(self, df: DataFrame, valid: Callable[[DataFrame], bool] | None = None, expected: int | None = None, notes: dict | None = None) -> int:
        """The table becomes df; its new version. valid checks what was written. expected: the version df was made from, else the last wins."""
        folder = self.stage(df)
        if valid is not None and not valid(self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{folder}")):
            self._fs.delete(self._at(f"{self.path}/data/{folder}"), True)
            raise ValueError(f"what was written for {self.path} isn't valid")
        while True:
            version = (max(self.versions(), default=0) if expected is None else expected) + 1
            try:
                self.put(version, [folder], _ddl(df), notes)
                return version
            except Conflict:
                if expected is not None:
                    self._fs.delete(self._at(f"{self.path}/data/{folder}"), True)
                    raise

    def append(self, df: DataFrame, notes: dict | None = None) -> int:
        """Rows beside those that are there; its new version."""
        folder = self.stage(df)
        while True:
            last, commit = self.current()
            try:
                self.put(last + 1, [*commit["folders"], folder], _ddl(df), notes)
                return last + 1
            except Conflict:
                continue

    def upsert(self, df: DataFrame, keys: Sequence[str], tries: int = 5) -> int:
        """Rows of df in place of those with the same keys; null keys match null keys. Made anew from the last version if another writer came before."""
        own = df.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        met = F.lit(True)
        for k in keys:
            met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
        for n in range(tries):
            last, commit = self.current()
            old = self.read(last).join(own, met, "left_anti").select(*df.columns) if commit["schema"] else df.limit(0)
            try:
                return self.replace(old.unionByName(df), expected=last)
            except Conflict:
                if n == tries - 1:
                    raise
        raise AssertionError

    def replace_tenants(self, df: DataFrame, tenant: str = "business_id", tries: int = 5) -> int:
        """All rows of the tenants that df has become df's; the others' stay. At once, whatever the number of tenants."""
        own = df.select(F.col(tenant).alias("__tenant")).distinct()
        for n in range(tries):
            last, commit = self.current()
            old = self.read(last).join(own, F.col(tenant).eqNullSafe(F.col("__tenant")), "left_anti").select(*df.columns) if commit["schema"] else df.limit(0)
            try:
                return self.replace(old.unionByName(df), expected=last)
            except Conflict:
                if n == tries - 1:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last keep versions names, and those versions' commits; the folders' names.

        Writes that go on meanwhile must be over: a folder that isn't committed yet isn't named either.
        """
        versions = self.versions()
        named = {f for v in versions[-keep:] for f in self.commit(v)["folders"]}
        gone = []
        if self._fs.exists(self._at(f"{self.path}/data")):
            gone = sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/data"))) if n not in named)
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"{self.path}/commits/{v:020d}.json"), False)
        for f in gone:
            self._fs.delete(self._at(f"{self.path}/data/{f}"), True)
        return gone


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
