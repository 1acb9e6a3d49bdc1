"""Tables in the shared folder: lineage cuts and workspace state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="provena-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write and read back: the plan starts anew from files that all executors share."""
    path = f"{shared_dir(df.sparkSession)}/provena-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WorkspaceError(RuntimeError):
    """A workspace that this version cannot read."""


class Workspace:
    """Parquet tables of an audit: records, pairs, comparisons, groups, errors, operations, variants.

    A version of a table is a list of folders.  A writer adds a folder, then
    writes the list under a new name that only then counts, so readers never
    see half a table; an append lists the old folders again and rewrites
    nothing.  Folders that none of the last KEEP lists names are deleted.
    """

    SCHEMA_VERSION = 7
    NAMES = ("images", "candidate_pairs", "comparisons", "groups", "scan_errors", "operations", "variants")
    KEEP = 4
    #: Folders of one table above which an append writes them as one.
    MAX_FOLDERS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path("schema_version")):
            self._save("schema_version", str(self.SCHEMA_VERSION))
        elif (found := int(self._load("schema_version"))) != self.SCHEMA_VERSION:
            raise WorkspaceError(f"{self.path} has schema {found}, this version reads {self.SCHEMA_VERSION}")

    def _path(self, tail: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tail}")

    def _load(self, tail: str) -> str:
        stream = self._fs.open(self._path(tail))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _save(self, tail: str, text: str) -> None:
        """A small file that appears whole."""
        stream = self._fs.create(self._path(f"{tail}.tmp"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.rename(self._path(f"{tail}.tmp"), self._path(tail))

    def _versions(self, name: str) -> list[str]:
        folder = self._path(f"{name}/versions")
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(v for v in found if not v.endswith(".tmp"))

    def version(self, name: str) -> str | None:
        return next(reversed(self._versions(name)), None)

    def _folders(self, name: str, version: str) -> list[str]:
        return self._load(f"{name}/versions/{version}").split()

    def read(self, name: str) -> DataFrame | None:
        """The table, or None if it was never written."""
        v = self.version(name)
        if v is None:
            return None
        folders = [f"{self.path}/{name}/{f}" for f in self._folders(name, v)]
        return self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*folders)

    def record(self, path: str) -> DataFrame | None:
        """The image record of a path, relative or real."""
        images = self.read("images")
        return None if images is None else images.where((F.col("relative_path") == path) | (F.col("real_path") == path))

    def _commit(self, name: str, df: DataFrame, before: list[str]) -> DataFrame:
        old = self.version(name)
        new = f"v{int(old[1:]) + 1 if old else 1:08d}"
        folder = f"{new}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}/{folder}")
        self._save(f"{name}/versions/{new}", "\n".join([*before, folder]))
        self._forget(name)
        return self.read(name)

    def _forget(self, name: str) -> None:
        versions = self._versions(name)
        kept = {f for v in versions[-self.KEEP :] for f in self._folders(name, v)}
        for v in versions[: -self.KEEP]:
            for f in set(self._folders(name, v)) - kept:
                self._fs.delete(self._path(f"{name}/{f}"), True)
            self._fs.delete(self._path(f"{name}/versions/{v}"), False)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Wipe and insert; earlier versions stay readable for a while."""
        return self._commit(name, df, [])

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Rows added to what is there."""
        v = self.version(name)
        before = self._folders(name, v) if v else []
        if len(before) >= self.MAX_FOLDERS:
            return self._commit(name, self.read(name).unionByName(df, allowMissingColumns=True), [])
        return self._commit(name, df, before)

    def replace_kind(self, kind: str, df: DataFrame) -> DataFrame:
        """Replace the groups of one kind and keep the others."""
        old = self.read("groups")
        return self.replace("groups", df if old is None else old.where(F.col("kind") != kind).unionByName(df))


def filled(df: DataFrame, found: DataFrame, key: str, *columns: str) -> DataFrame:
    """``df`` with the columns of ``found`` (one row a key) where it has the key, and its own values elsewhere."""
    other = found.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = df.join(other, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    return out.select(*df.columns)


def raised(df: DataFrame, ids: DataFrame, flag: str, key: str = "id") -> DataFrame:
    """``df`` with a flag set for the keys of ``ids``; a flag that is set stays set."""
    out = df.join(ids.select(key).distinct().withColumn("_raised", F.lit(True)), key, "left")
    return out.withColumn(flag, F.coalesce(flag, F.lit(False)) | F.coalesce("_raised", F.lit(False))).select(*df.columns)


def upsert(old: DataFrame | None, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with equal keys; nothing is deleted."""
    return new if old is None else old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def unchanged(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Records to reuse: equal real path, size and modification time."""
    return known.join(seen.select("real_path", "size_bytes", "modified_at"), ["real_path", "size_bytes", "modified_at"], "left_semi")


def changed(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that must be inspected again."""
    return seen.join(known.select("real_path", "size_bytes", "modified_at"), ["real_path", "size_bytes", "modified_at"], "left_anti")
