"""Tables under a manifest: several frames become visible at once, by the swap of one small file."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_atomically(path: str, data: bytes) -> None:
    """A sibling is written, flushed and renamed into place, then the folder is flushed; readers see the old or the new file, whole."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder, prefix=".knowloom-", suffix=".tmp")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise
    at = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


def inside(root: str, path: str) -> str:
    """The real path of ``path`` below ``root``; climbing out, by dots or links, is refused."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path!r} leads out of {root!r}")
    return full


#: Appended parts of a table after which it is written anew.
MOST_PARTS = 20


class Store:
    """Versioned Parquet tables below a folder that all executors share; one writer at a time.

    A table is one folder, or one folder and parts appended since, of which each later row replaces those of equal keys.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def _manifest(self) -> str:
        return f"{self.root}/manifest.json"

    def versions(self) -> dict:
        if not os.path.exists(self._manifest):
            return {}
        with open(self._manifest, encoding="utf-8") as f:
            return json.load(f)

    def read(self, name: str) -> DataFrame:
        """The table as it stands: its rows, or of equal keys those of the part appended last."""
        versions = self.versions()
        base, log = self.spark.read.parquet(f"{self.root}/{versions[name]}"), versions.get(f"{name}@parts")
        if not log:
            return base
        both = base.withColumn("_part", F.lit(0))
        for i, path in enumerate(log["paths"], 1):
            both = both.unionByName(self.spark.read.schema(base.schema).parquet(f"{self.root}/{path}").withColumn("_part", F.lit(i)))
        rest = [c for c in base.columns if c not in log["keys"]]
        return both.groupBy(*log["keys"]).agg(F.max_by(F.struct(*rest), "_part").alias("_r")).select(*log["keys"], "_r.*").select(*base.columns)

    def append(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Add ``rows``, unique by ``keys``, that replace the table's rows of equal keys when it is read; the cost is that of the rows.

        After MOST_PARTS parts the table is written as one folder again.
        """
        path = f"{name}/{uuid.uuid4().hex}"
        versions = self.versions()
        base = self.spark.read.parquet(f"{self.root}/{versions[name]}")
        rows.select(*base.columns).write.parquet(f"{self.root}/{path}")
        log = versions.get(f"{name}@parts", {"keys": list(keys), "paths": []})
        log["paths"].append(path)
        self._publish(versions | {f"{name}@parts": log})
        if len(log["paths"]) >= MOST_PARTS:
            self.commit(**{name: self.read(name)})

    def commit(self, **frames: DataFrame) -> dict[str, str]:
        """Write every frame to a folder of its own, then swap the manifest. If one fails nothing becomes visible."""
        new = {}
        for name, df in frames.items():
            new[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{new[name]}")
        merged = {k: v for k, v in self.versions().items() if k.removesuffix("@parts") not in new} | new
        self._publish(merged)
        return merged

    def _publish(self, versions: dict) -> None:
        write_atomically(self._manifest, json.dumps(versions, indent=1, sort_keys=True).encode())

    def vacuum(self) -> list[str]:
        """Remove versions that the manifest does not name."""
        import shutil

        live, gone = set(), []
        for v in self.versions().values():
            live.update(v["paths"] if isinstance(v, dict) else [v])
        for name in os.listdir(self.root):
            folder = os.path.join(self.root, name)
            if os.path.isdir(folder):
                for v in os.listdir(folder):
                    if f"{name}/{v}" not in live:
                        shutil.rmtree(os.path.join(folder, v), ignore_errors=True)
                        gone.append(f"{name}/{v}")
        return gone


def write_files(pages: DataFrame, root: str) -> None:
    """Write ``pages`` (path, content), one file each, from the tasks that hold them; ``root`` is a shared folder. Paths are checked."""

    def write(rows) -> None:  # noqa: ANN001
        for r in rows:
            write_atomically(inside(root, r["path"]), r["content"].encode())

    pages.select("path", "content").foreachPartition(write)


def write_mirrors(pages: DataFrame, root: str) -> list[str]:
    """Write ``pages`` (path, content) below ``root`` and remove the documents there that are no longer among them; their paths."""
    write_files(pages, root)
    return orphan_files(root, pages, ".md")


def orphan_paths(here: DataFrame, wanted: DataFrame) -> DataFrame:
    """The paths of ``here`` (path) that ``wanted`` (path) does not name."""
    return here.select("path").distinct().join(wanted.select("path").distinct(), "path", "left_anti")


def orphan_files(root: str, wanted: DataFrame, suffix: str = ".json") -> list[str]:
    """Files below ``root`` that ``wanted`` (path) does not name, by an anti join, removed and returned."""
    found = [os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if f.endswith(suffix) and not f.startswith(".")]
    if not found:
        return []
    here = wanted.sparkSession.createDataFrame([(p,) for p in found], "path string")
    gone = [r["path"] for r in orphan_paths(here, wanted).collect()]
    for p in gone:
        os.unlink(inside(root, p))
    return sorted(gone)
