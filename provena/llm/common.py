"""Shared plumbing: shared-folder tables, batch limits and block iteration.

Everything that must outlive a task is written under the folder the session
names in ``spark.checkpoint.dir`` (all executors and the driver share it); a
private folder is chosen only where that setting is absent and driver and
executors are one process, as in tests.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS_CLASS = r"[\x20\x09-\x0D]"
#: The characters of that class, for translate().
WS_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="provena-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/provena-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, *partition_cols: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executors."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the folder of a table that ``materialise`` has made and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def gathered(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` as ``bucketed`` deals its buckets, which are a file each then and not one for every task."""
    return df.repartition(_buckets(df.sparkSession), key)


def _buckets(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, key: str, compression: str = "zstd", path: str | None = None) -> str:
    """Name of a table in the shared folder bucketed by ``key``: joins on the key leave its rows where they are."""
    spark = df.sparkSession
    name = f"provena_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", compression).option("path", path or fresh_dir(spark, "table")).bucketBy(_buckets(spark), key).saveAsTable(name)
    return name


def pack(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a.tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def mapped_column(df: DataFrame, source: str, name: str, kind: str, fn: Callable[[list], pa.Array]) -> DataFrame:
    """``df`` with one more column, made from the values of ``source`` batch by batch; all rows and columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], name])
        trim()

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields] + [T.StructField(name, T._parse_datatype_string(kind), True)])
    bound_batches(df.sparkSession)
    return df.select("*", F.col(source).alias(spare_name(df, "__source"))).mapInArrow(run, schema)


FILTER_BITS = 20


def row_mark(key: str, text: str) -> Column:
    """64 bits of a row's key and whole text: rows repeated under one key are told apart by their texts."""
    return F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))


def without(df: DataFrame, dropped: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``df`` whose (key, ``row_mark``) is not among ``dropped`` (key, mark); rows with a null key stay.

    A bitmap of 2**FILTER_BITS buckets of the dropped marks, a fixed size, is
    broadcast; only rows that it hits are shuffled for the exact anti-join.
    """
    mark, spot, hit = (spare_name(df, n) for n in ("__mark", "__spot", "__hit"))
    gone = materialise(dropped.select(F.col(key), F.col("mark").alias(mark)).where(F.col(key).isNotNull()).distinct(), "dropped")
    bitmap = gone.select(F.pmod(F.col(mark), F.lit(1 << FILTER_BITS)).alias(spot)).distinct().withColumn(hit, F.lit(True))
    marked = df.withColumn(mark, row_mark(key, text)).withColumn(spot, F.pmod(F.col(mark), F.lit(1 << FILTER_BITS))).join(F.broadcast(bitmap), spot, "left")
    clear = marked.where(F.col(hit).isNull() | F.col(key).isNull()).select(*df.columns)
    maybe = marked.where(F.col(hit) & F.col(key).isNotNull())
    return clear.unionByName(maybe.join(gone, [key, mark], "left_anti").select(*df.columns))


#: At most 2**MARK_WORDS words of 64 bits mark the keys of ``likely``.
MARK_WORDS = 20


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be among those of ``keys``: all that are, and a few others, for an exact join behind it.

    A bitmap of the keys' hashes is broadcast as words of 64 bits, eight bits
    or more a key up to 2**MARK_WORDS words; beyond that more other rows pass.
    """
    kind = rows.schema[key].dataType.simpleString()
    if kind != keys.schema[key].dataType.simpleString() or kind not in ("smallint", "int", "bigint", "string"):
        return rows  # equal keys may have different hashes
    words = 1 << min(MARK_WORDS, max(10, (keys.count() // 8).bit_length()))
    spot, bit = F.pmod(F.xxhash64(key), F.lit(words)), F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(64)).cast("int")
    marks = keys.select(spot.alias("_spot"), bit.alias("_bit")).groupBy("_spot").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    marked = rows.withColumn("_spot", spot).withColumn("_bit", bit).join(F.broadcast(marks), "_spot")
    return marked.where("shiftright(_bits, _bit) & 1 = 1").select(*rows.columns)


def bound_batches(spark: SparkSession, records: int = 1024, size: str = "4m") -> None:
    """Keep Arrow batches small enough for long texts; explicit user settings win."""
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", {"10000"}, str(records)),
        ("spark.sql.execution.arrow.maxBytesPerBatch", None, size),
    ):
        try:
            now = spark.conf.get(key)
        except Exception:
            continue
        if default is None or now in default:
            spark.conf.set(key, value)


def lower_az(text: str) -> str:
    """Lower-case A-Z only: bytes.lower() leaves the bytes of other characters alone."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def trim() -> None:
    """Give freed memory back: workers are reused, and what one stage freed counts against the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def grouped(fn: Callable) -> Callable:
    """A function for applyInArrow that gives its memory back after every group."""

    def run(*tables: pa.Table) -> pa.Table:
        try:
            return fn(*tables)
        finally:
            trim()

    # Spark tells functions of one and of two tables (and of a key before them) by their number of parameters.
    return (lambda table: run(table)) if len(inspect.signature(fn).parameters) == 1 else (lambda left, right: run(left, right))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def blocks_of(batches: Iterator[pa.RecordBatch], rows: int, text_column: str = "text", chars: int = 32 << 20) -> Iterator[list[pa.RecordBatch]]:
    """Group a task's batches into blocks of about ``chars`` bytes of text (or ``rows`` rows)."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        size += batch.column(text_column).nbytes
        if n >= rows or size >= chars:
            yield held
            held, n, size = [], 0, 0
    if held:
        yield held


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
