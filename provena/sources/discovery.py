"""Finding image files: the walk, formats by content and extension, duplicate real paths."""

from __future__ import annotations

import ctypes
import os
import re
import struct
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions.paths import EXTENSION_FORMATS, glob_to_regex

SNIFF_BYTES = 16
ENTRY = (
    "input_index int, input_directory string, path string, absolute_path string, real_path string, status string, reason string, head binary, "
    "size_bytes bigint, modified_at string, created_at string, inode bigint, device bigint"
)


def format_by_extension(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in EXTENSION_FORMATS.items()])


def format_by_content(head: Column) -> Column:
    """Format by the first bytes of a file."""
    h = F.hex(head)
    return (
        F.when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "gif")
        .when((F.substring(h, 9, 8) == "66747970") & F.substring(h, 17, 8).isin("61766966", "61766973"), "avif")
    )


def resolve_format(files: DataFrame, name: str, head: str) -> DataFrame:
    """Content wins over extension; neither means unsupported; a conflict is noted in ``reason``."""
    out = files.withColumn("extension", F.regexp_extract(F.col(name), r"\.([^./]+)$", 1)).withColumn("by_extension", format_by_extension(F.col(name))).withColumn("by_content", format_by_content(F.col(head)))
    conflict = F.when(F.col("by_content") != F.col("by_extension"), F.concat(F.lit("extension suggests "), F.col("by_extension"), F.lit(", content is "), F.col("by_content")))
    return (
        out.withColumn("format", F.coalesce("by_content", "by_extension"))
        .withColumn("status", F.when(F.col("format").isNull(), "unsupported").otherwise("candidate"))
        .withColumn("reason", F.when(F.col("format").isNull(), "unrecognised image format").otherwise(conflict))
    )


def first_real_path(files: DataFrame) -> DataFrame:
    """The first path of each real path, across all inputs, stays a candidate."""
    order = F.struct(F.col("input_index"), F.collate("absolute_path", "UNICODE").alias("path"))
    first = files.groupBy("real_path").agg(F.min_by(F.struct("input_index", "absolute_path"), order).alias("_first"))
    own = (F.col("input_index") == F.col("_first.input_index")) & (F.col("absolute_path") == F.col("_first.absolute_path"))
    return files.join(first, "real_path").withColumn("status", F.when(own, "candidate").otherwise("duplicate-path")).drop("_first")


#: Fixed values of the system call: the current folder, the field asked for, where the answer has it.
_AT_FDCWD, _STATX_BTIME, _BTIME_OFFSET = -100, 0x800, 80


def birth_time(path: str, stat: os.stat_result) -> float:
    """Seconds since the epoch at which a file was created; where the system does not know, the time of its last status change."""
    if hasattr(stat, "st_birthtime"):
        return stat.st_birthtime
    buffer = ctypes.create_string_buffer(256)
    try:
        failed = ctypes.CDLL(None, use_errno=True).statx(_AT_FDCWD, os.fsencode(path), 0, _STATX_BTIME, buffer)
    except (OSError, AttributeError):
        failed = True
    if failed or not struct.unpack_from("I", buffer, 0)[0] & _STATX_BTIME:
        return stat.st_ctime
    seconds, nanos = struct.unpack_from("qI", buffer, _BTIME_OFFSET)
    return seconds + nanos / 1e9


def _iso(seconds: float) -> str:
    return datetime.fromtimestamp(seconds, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def walk(inputs: Sequence[str], include: Sequence[str], exclude: Sequence[str], workspace: str | None = None, follow_symlinks: bool = True) -> Iterator[tuple]:
    """Rows of ENTRY: files under the inputs by path; hidden files count, linked folders are not entered."""
    wanted = [re.compile(glob_to_regex(p), re.I) for p in include]
    for index, given in enumerate(inputs):
        root = os.path.abspath(given)
        skip = list(exclude)
        if workspace and (inside := os.path.relpath(os.path.abspath(workspace), root)) and not inside.startswith(".."):
            skip.append(f"{inside}/**")
        banned = [re.compile(glob_to_regex(p), re.I) for p in skip]
        found = []
        for folder, folders, names in os.walk(root):
            folders.sort()
            found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names]
        for path in sorted(found):
            if not any(p.match(path) for p in wanted) or any(p.match(path) for p in banned):
                continue
            absolute = os.path.join(root, path)
            row = (index, given, path, absolute)
            try:
                real = os.path.realpath(absolute, strict=True)
                stat = os.stat(real)
                with open(real, "rb") as f:
                    head = f.read(SNIFF_BYTES)
            except OSError as e:
                loop = e.errno == 40
                yield (*row, None, "symlink-skipped" if loop else "inaccessible", "symbolic link loop" if loop else str(e.strerror), None, None, None, None, None, None)
                continue
            if not follow_symlinks and real != absolute:
                yield (*row, real, "symlink-skipped", "symbolic links are not followed", None, None, None, None, None, None)
                continue
            yield (*row, real, None, None, head, stat.st_size, _iso(stat.st_mtime), _iso(birth_time(real, stat)), stat.st_ino, stat.st_dev)


def discover(spark: SparkSession, inputs: Sequence[str], include: Sequence[str], exclude: Sequence[str] = (), workspace: str | None = None, follow_symlinks: bool = True) -> DataFrame:
    """Discovery entries: path, real path, format, and status (candidate, unsupported, duplicate-path, symlink-skipped, inaccessible)."""
    rows = spark.createDataFrame(list(walk(inputs, include, exclude, workspace, follow_symlinks)), ENTRY)
    open_rows = first_real_path(rows.where("status is null")).withColumnRenamed("status", "_path_status")
    resolved = resolve_format(open_rows.drop("status", "reason"), "path", "head")
    resolved = resolved.withColumn("status", F.when(F.col("_path_status") == "duplicate-path", F.col("_path_status")).otherwise(F.col("status")))
    shut = rows.where("status is not null").select("*", F.lit(None).cast("string").alias("format"))
    return resolved.select(*rows.columns, "format").unionByName(shut.select(*rows.columns, "format")).drop("head")


__all__ = ["discover", "first_real_path", "format_by_content", "format_by_extension", "resolve_format", "walk"]
