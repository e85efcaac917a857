"""Tables that are published together: folders nobody overwrites, and one record that names them.

A load writes new folders, which nobody sees, and then one small record that says which
folders are each table from now on. Readers start from the newest record, so they
find the tables of one load or of the next, never of both; a load that stops in between leaves no trace
but unused folders.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RECORDS = "_versions"
WHOLE = ""  # the only part of a table that is not kept in parts


class Versions:
    """Published tables under `root`, a folder every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._conf = spark._jsc.hadoopConfiguration()
        path = self._path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")

    def _children(self, folder: str) -> list:
        path = self._path(folder)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def latest(self) -> int:
        """Number of the newest record; 0 before the first."""
        names = [s.getPath().getName() for s in self._children(f"{self.root}/{RECORDS}")]
        return max((int(n.removesuffix(".json")) for n in names if n[:1].isdigit()), default=0)

    def record(self, version: int | None = None) -> dict:
        """Table names to their schema and to the folder of each part."""
        version = self.latest() if version is None else version
        if version == 0:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/{RECORDS}/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def parts(self, table: str, version: int | None = None) -> list[str]:
        return sorted(self.record(version).get(table, {}).get("parts", {}))

    def read(self, table: str, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest if none is named; of all its parts or of those named."""
        entry = self.record(version).get(table)
        if entry is None:
            raise ValueError(f"{self.root} has no table {table}")
        wanted = entry["parts"] if parts is None else {p: entry["parts"][p] for p in parts if p in entry["parts"]}
        return self.open(table, T.StructType.fromJson(entry["schema"]), list(wanted.values()))

    def open(self, table: str, schema: T.StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        # `load` is the folder a row was written to; reading it as a column keeps the parts' own columns.
        with_load = T.StructType([*schema.fields, T.StructField("load", T.StringType())])
        reader = self.spark.read.schema(with_load).option("basePath", f"{self.root}/{table}")
        paths = [f"{self.root}/{table}/{f}" for f in folders]
        return reader.parquet(*paths).select(*schema.names)

    def begin(self) -> Draft:
        return Draft(self)

    def discard_unused(self, keep: int = 2, older_than_s: float = 7 * 24 * 3600) -> list[str]:
        """Delete folders that none of the newest `keep` records names, and older records; returns them.

        Folders younger than `older_than_s` stay, as a load may be writing them.
        """
        newest = self.latest()
        kept = range(max(1, newest - keep + 1), newest + 1)
        used: dict[str, set[str]] = {}
        for version in kept:
            for table, entry in self.record(version).items():
                used.setdefault(table, set()).update(f.split("/")[0] for f in entry["parts"].values())
        limit = (time.time() - older_than_s) * 1000
        gone = []
        for table in [s.getPath().getName() for s in self._children(self.root)]:
            for status in self._children(f"{self.root}/{table}"):
                name = status.getPath().getName()
                if table == RECORDS:
                    stays = not name[:1].isdigit() or int(name.removesuffix(".json")) in kept
                else:
                    stays = name in used.get(table, ()) or not name.startswith("load=")
                if not stays and status.getModificationTime() <= limit:
                    self._fs.delete(status.getPath(), True)
                    gone.append(f"{table}/{name}")
        return gone


class Draft:
    """Tables of one load, unseen until they are published."""

    def __init__(self, versions: Versions):
        self.versions = versions
        self.base = versions.latest()
        self.written: dict[str, dict] = {}

    def write(self, table: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write the rows to a folder of their own and read them back; `by` keeps one part per value."""
        v = self.versions
        load = f"load={uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{v.root}/{table}/{load}")
        if by:
            names = [s.getPath().getName() for s in v._children(f"{v.root}/{table}/{load}")]
            parts = {unquote(n.split("=", 1)[1]): f"{load}/{n}" for n in names if n.startswith(f"{by}=")}
        else:
            parts = {WHOLE: load}
        self.written[table] = {"schema": df.schema.jsonValue(), "parts": parts}
        return v.open(table, df.schema, list(parts.values()))

    def publish(self, replaced: list[str] | None = None) -> int:
        """Make all tables written visible at once; returns the new version.

        A table in parts keeps the parts of the version before, except those written and those
        named in `replaced`. Stops if another load was published since this one began.
        """
        v = self.versions
        record = v.record(self.base)
        for table, entry in self.written.items():
            before = record.get(table, {}).get("parts", {})
            if WHOLE in before or WHOLE in entry["parts"]:
                before = {}
            stays = {p: f for p, f in before.items() if p not in (replaced or ())}
            record[table] = {**entry, "parts": {**stays, **entry["parts"]}}
        number = self.base + 1
        draft = v._path(f"{v.root}/{RECORDS}/.{uuid.uuid4().hex}.json")
        final = v._path(f"{v.root}/{RECORDS}/{number:012d}.json")
        out = v._fs.create(draft, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        jvm = v.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), v._conf)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = v.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(draft, final, options)
        except Exception as error:
            v._fs.delete(draft, False)
            if v._fs.exists(final):
                raise RuntimeError(f"version {number} of {v.root} was published by another load") from error
            raise
        return number
