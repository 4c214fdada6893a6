"""Versioned snapshots of an engine's tables as Parquet, with numbered manifests.

A table is a list of parts; a version adds parts or replaces them, so a batch
writes what it brings and not what is there.  Each version has a manifest file
of its own, which appears by a rename to a new name: a reader finds the last
complete one, and never a state in between.  A second writer of the same
version fails.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 2
TABLES = ("records", "descriptors", "keys", "assignments", "conflicts")
#: Parts of a table after which the next version writes it as one.
PARTS = 32
_NAME = "_manifest-"


def add_to_ranges(ranges: list[list[int]], value: int) -> list[list[int]]:
    """Sorted disjoint [low, high] ranges with one more value."""
    out: list[list[int]] = []
    for low, high in sorted([*map(list, ranges), [value, value]]):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _read(self, name: str) -> str | None:
        fs, p = self._fs(), self._path(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _names(self, prefix: str) -> list[str]:
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.globStatus(self._path(f"{prefix}*")) or []) if fs.exists(self._path("")) else []

    def _publish(self, manifest: dict) -> None:
        """Writes beside and renames to a name that no earlier version has."""
        fs, p, side = self._fs(), self._path(f"{_NAME}{manifest['version']:012d}"), self._path(f".manifest-{uuid.uuid4().hex}")
        out = fs.create(side, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if fs.exists(p) or not fs.rename(side, p):
            fs.delete(side, False)
            raise OSError(f"version {manifest['version']} was written by another")

    def manifest(self, version: int | None = None) -> dict | None:
        names = self._names(_NAME) if version is None else [f"{_NAME}{version:012d}"]
        text = self._read(names[-1]) if names else self._read("_current")  # the name that earlier formats used
        if text is None:
            return None
        found = json.loads(text)
        if found.get("format") != FORMAT:
            raise ValueError(f"snapshot format {found.get('format')}, expected {FORMAT}")
        return found

    def version(self) -> int:
        m = self.manifest()
        return m["version"] if m else 0

    def parts(self, table: str) -> list[str]:
        m = self.manifest()
        return m["parts"].get(table, []) if m else []

    def load(self, table: str) -> DataFrame | None:
        found = self.parts(table)
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in found]) if found else None

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, batch_id: int | None = None, ontology: str | None = None, keep: bool = True) -> int:
        """Writes the next version; a repeated ``batch_id`` changes nothing.  Without ``keep`` other tables are left out."""
        m = self.manifest() or {"version": 0, "parts": {}, "batches": [], "ontology": None}
        if batch_id is not None and self._has(m, batch_id):
            return m["version"]
        version = m["version"] + 1
        parts = {t: list(p) for t, p in m["parts"].items()} if keep else {}
        for name, df in {**(replace or {}), **(append or {})}.items():
            at = f"v{version}-{uuid.uuid4().hex[:8]}/{name}"  # a name of its own, so that a failed attempt leaves nothing in the way
            old = parts.get(name, []) if append and name in append else []
            if len(old) >= PARTS:
                df = self.spark.read.parquet(*[f"{self.root}/{p}" for p in old]).unionByName(df)
                old = []
            df.write.parquet(f"{self.root}/{at}")
            parts[name] = [*old, at]
        batches = add_to_ranges(m["batches"], batch_id) if batch_id is not None else m["batches"]
        self._publish({"format": FORMAT, "version": version, "parts": parts, "batches": batches, "ontology": ontology or m["ontology"], "written": int(time.time())})
        return version

    def save(self, tables: dict[str, DataFrame], batch_id: int | None = None, ontology: str | None = None) -> int:
        """Writes the next version, which has these tables and no others."""
        return self.commit(replace=tables, batch_id=batch_id, ontology=ontology, keep=False)

    @staticmethod
    def _has(m: dict, batch_id: int) -> bool:
        return any(low <= batch_id <= high for low, high in m["batches"])

    def committed(self, batch_id: int) -> bool:
        m = self.manifest()
        return bool(m and self._has(m, batch_id))

    def copy_to(self, root: str) -> SnapshotStore:
        """A checkpoint of the current version elsewhere."""
        other, m = SnapshotStore(self.spark, root), self.manifest()
        if m:
            other.save({t: self._plain(t) for t in m["parts"]}, ontology=m["ontology"])
        return other

    def _plain(self, table: str) -> DataFrame:
        """A table as one part: of rows in several versions the last."""
        df = self.load(table)
        return df.groupBy("record_id").agg(F.max_by("cluster_id", "version").alias("cluster_id"), F.max("version").alias("version")) if "version" in df.columns else df

    def reset(self) -> None:
        self._fs().delete(self._path(""), True)

    def repair(self) -> int:
        """Removes manifests of which a part is missing, from the last one back; the version that is whole then counts."""
        fs = self._fs()
        for name in reversed(self._names(_NAME)):
            found = json.loads(self._read(name))
            if all(fs.exists(self._path(p)) for of in found["parts"].values() for p in of):
                break
            fs.delete(self._path(name), False)
        return self.version()

    def prune(self, keep: int = 2) -> None:
        """Removes all but the last versions, and the parts that none of these has."""
        fs, names = self._fs(), self._names(_NAME)
        for name in names[: max(0, len(names) - keep)]:
            fs.delete(self._path(name), False)
        used = {p.split("/")[0] for name in self._names(_NAME) for of in json.loads(self._read(name))["parts"].values() for p in of}
        for folder in self._names("v"):
            if folder not in used:
                fs.delete(self._path(folder), True)
