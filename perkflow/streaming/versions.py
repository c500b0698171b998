"""Files of a single-writer job whose every run publishes one version of all its tables.

A run writes only into folders that carry its own version number, and its last
step is a commit file that names, for every keyed table, the version of each
part (a date or a bucket of keys). Readers take what the newest commit names.
An interrupted run leaves folders that no commit names; the next run has the
same number and overwrites them, so nothing is lost or read twice.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Commit:
    """``tables``: name -> part -> version. ``facts``: what else the job must remember."""
    version: int = -1
    facts: dict = field(default_factory=dict)
    tables: dict[str, dict[str, int]] = field(default_factory=dict)

    def next(self, facts: dict, tables: dict[str, dict[str, int]]) -> Commit:
        return Commit(self.version + 1, {**self.facts, **facts}, {**self.tables, **tables})


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hpath

    def names(self, path: str) -> list[str]:
        fs, hpath = self._at(path)
        return [f.getPath().getName() for f in fs.listStatus(hpath)] if fs.exists(hpath) else []

    def newest(self) -> Commit:
        done = [int(n) for n in self.names(f"{self.root}/commits") if n.isdigit()]
        if not done:
            return Commit()
        fs, hpath = self._at(f"{self.root}/commits/{max(done)}")
        stream = fs.open(hpath)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Commit(**json.loads(text))

    def commit(self, c: Commit) -> None:
        """Written under another name and renamed, so that a reader sees all of it or nothing."""
        fs, draft = self._at(f"{self.root}/commits/draft-{c.version}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(c.__dict__).encode()))
        out.close()
        if not fs.rename(draft, self._at(f"{self.root}/commits/{c.version}")[1]):
            raise RuntimeError(f"version {c.version} of {self.root} is already committed: is there a second writer?")

    def folder(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/version={version}"

    # --- keyed tables: the newest version of every part ---------------------------------------
    def read_parts(self, c: Commit, table: str, part: str, schema: T.StructType, wanted=None) -> DataFrame:
        """The rows of the ``wanted`` parts (None: all); only their files are listed and read."""
        held = c.tables.get(table, {})
        keys = held if wanted is None else [str(w) for w in wanted if str(w) in held]
        paths = [f"{self.folder(table, held[k])}/{part}={k}" for k in keys]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths) \
            .select(*schema.fieldNames())

    def write_parts(self, c: Commit, table: str, part: str, rows: DataFrame, touched) -> dict[str, int]:
        """Rewrite the ``touched`` parts in the next version; returns the table's new part -> version."""
        version = c.version + 1
        path = self.folder(table, version)
        rows.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(path)
        kept = {k: v for k, v in c.tables.get(table, {}).items() if k not in {str(t) for t in touched}}
        written = [n.split("=", 1)[1] for n in self.names(path) if n.startswith(f"{part}=")]
        return {**kept, **{k: version for k in written}}

    def expirable(self, table: str, keep: int = 2) -> list[str]:
        """Version folders of a keyed table that neither the newest commit nor the ``keep`` versions before it use."""
        c = self.newest()
        needed = set(c.tables.get(table, {}).values())
        found = [int(n.split("=")[1]) for n in self.names(f"{self.root}/{table}") if n.startswith("version=")]
        return [self.folder(table, v) for v in sorted(found) if v not in needed and v < c.version - keep]
