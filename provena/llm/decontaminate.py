"""Benchmark decontamination: one Aho-Corasick automaton over normalised items.

Items and documents are lower-cased (A-Z only) and cut into words of digits,
letters and non-ASCII characters.  Every run of ``window`` consecutive item
words (the whole item when it has fewer) becomes one pattern of an automaton
over word numbers; a document's words are numbered by the items' words and
scanned once, and the hits are mapped back to character offsets of the original.

The benchmark's size is checked: one of at most ``MAX_PATTERN_CHARS`` characters
is broadcast and scanned with one automaton.  A larger one is cut into pieces
that are dealt into groups of that size, a table in the shared folder; a task
then reads group after group for every block of its documents, so memory is
that of one automaton and one block, and every row is still one row.

Edge cases: null and empty texts have no words; an item without words has no
pattern; items that share a window are all reported; windows of an item with a
null id count as hits, and no id is reported for them; repeated rows and null
keys pass through row by row, whatever the size of the benchmark; further
columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_of, fresh_dir, lower_az, map_arrow, spare_name

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Characters of item text behind one automaton, which has at most two nodes a character.
MAX_PATTERN_CHARS = 1 << 20
#: Windows of one piece of an item, where a benchmark is dealt into groups.
PIECE_WINDOWS = 2048
BLOCK_CHARS = 16 << 20
#: Characters of a word's number: three digits, each from characters of its own, so that a match starts with a word.
#: A node of the automaton has at most a few hundred children that way, which it searches one by one.
DIGITS = 3
_LOW, _MIDDLE, _HIGH, _BASE = 0x100, 0x180, 0x200, 128
_UNKNOWN = " " * DIGITS

Item = tuple[str | None, str | None]
Hits = tuple[int, list[tuple[int, int]], set[str]]

#: The matcher that a worker process used last, by the digest of its items.
_LAST: dict[str, Matcher] = {}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_az(text)) if text else []


def numeral(n: int) -> str:
    """DIGITS characters for a word's number."""
    high, rest = divmod(n, _BASE * _BASE)
    return chr(_HIGH + high) + chr(_MIDDLE + rest // _BASE) + chr(_LOW + rest % _BASE)


class Matcher:
    """The numbers of the items' words, DIGITS characters each, and the automaton over runs of them."""

    def __init__(self, items: list[Item], window: int):
        import ahocorasick

        self.index: dict[str, str] = {}
        owners: dict[str, set[str]] = {}
        get = self.index.setdefault
        for item, text in items:
            words = [get(w, numeral(len(self.index))) for w in words_of(text)]
            for i in range(max(1, len(words) - window + 1)) if words else ():
                own = owners.setdefault("".join(words[i : i + window]), set())
                if item is not None:
                    own.add(item)
        self.automaton = ahocorasick.Automaton()
        shared: dict[tuple, tuple] = {}
        for run, ids in owners.items():
            value = (len(run) // DIGITS, tuple(sorted(ids)))
            self.automaton.add_word(run, shared.setdefault(value, value))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def __call__(self, text: str | None) -> Hits:
        """Number of words, hit word ranges (merged, end exclusive) and the items found."""
        words = words_of(text)
        if not words or self.empty:
            return len(words), [], set()
        get = self.index.get
        found = [(end // DIGITS + 1, n, ids) for end, (n, ids) in self.automaton.iter("".join([get(w, _UNKNOWN) for w in words]))]  # a space is in no pattern
        return len(words), merged([(end - n, end) for end, n, _ in found]), {i for _, _, ids in found for i in ids}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of hit word ranges."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(lower_az(text))]  # lower-casing A-Z moves no offset
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def matcher(name: str, items: Callable[[], list[Item]], window: int) -> Matcher:
    """The matcher of a worker process: built once, and the only one that it keeps."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Matcher(items(), window)
    return _LAST[name]


class Benchmark:
    """What tasks need of the items: all of them, broadcast, or the folders of their groups."""

    def __init__(self, items: DataFrame, item: str, text: str, window: int, max_chars: int):
        self.window = window
        rows = items.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        chars = int(rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0)
        self.groups: list[str] = []
        if chars <= max_chars:
            held = [tuple(r) for r in rows.collect()]  # at most max_chars characters
            self.name = hashlib.sha1(repr((sorted(held, key=repr), window)).encode()).hexdigest()
            self.shared = rows.sparkSession.sparkContext.broadcast(held)
            return
        self.shared, self.name = None, ""
        parts = -(-2 * chars // max_chars)  # a group is half full on average
        path = fresh_dir(rows.sparkSession, "benchmark")
        pieces = map_arrow(rows, _pieces(window), "item string, text string")
        dealt = F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int")
        pieces.withColumn("part", dealt).repartition("part").write.partitionBy("part").parquet(path)
        self.groups = [f"{path}/part={k}" for k in range(parts)]

    def read(self, folder: str) -> list[Item]:
        store, root = fs.FileSystem.from_uri(folder)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return []  # no piece fell to this group
        table = ds.dataset(root, filesystem=store, format="parquet").to_table(columns=["item", "text"])
        return list(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True))

    def scan(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[Hits]]]:
        """Batches with the hits of every row."""
        if self.shared is not None:
            find = matcher(self.name, lambda: self.shared.value, self.window)
            for batch in batches:
                yield batch, [find(t) for t in batch.column(column).to_pylist()]
            return
        for held in blocks_of(batches, 1 << 16, column, BLOCK_CHARS):
            texts = [t for batch in held for t in batch.column(column).to_pylist()]
            every: list[Hits] = [(0, [], set())] * len(texts)
            for folder in self.groups:
                find = Matcher(self.read(folder), self.window)
                for i, t in enumerate(texts):
                    n, ranges, items = find(t)
                    _, old, known = every[i]
                    every[i] = (n, merged(old + ranges) if ranges else old, known | items if items else known)
            at = 0
            for batch in held:
                yield batch, every[at : at + batch.num_rows]
                at += batch.num_rows


def _pieces(window: int):
    """Items as pieces of at most PIECE_WINDOWS windows; every window is in exactly one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                rows += [(item, " ".join(words[i : i + PIECE_WINDOWS + window - 1])) for i in range(0, max(1, len(words) - window + 1), PIECE_WINDOWS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["item", "text"])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_pattern_chars: int = MAX_PATTERN_CHARS
) -> DataFrame:
    """One row per input row: ``key, n_words, ranges, spans, items``.

    ``ranges``: merged hit word ranges; ``spans``: the same as character
    offsets of the original text; ``items``: ids of the items found, sorted as
    strings.
    """
    known = Benchmark(benchmark, item, item_text, window, max_pattern_chars)
    kind = docs.schema[key].dataType.simpleString()
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in known.scan(batches, "_text"):
            texts = batch.column("_text")
            spans = [original_spans(texts[i].as_py(), ranges) if ranges else [] for i, (_, ranges, _) in enumerate(hits)]
            as_rows = lambda xs: pa.array([[{"start": a, "end": b} for a, b in x] for x in xs], pair)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in hits], pa.int64()), as_rows([r for _, r, _ in hits]), as_rows(spans), pa.array([sorted(i) for _, _, i in hits], pa.list_(pa.string()))],
                ["_key", "n_words", "ranges", "spans", "items"],
            )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    span = "array<struct<start:bigint,end:bigint>>"
    return map_arrow(rows, run, f"_key {kind}, n_words bigint, ranges {span}, spans {span}, items array<string>").withColumnRenamed("_key", key)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_pattern_chars: int = MAX_PATTERN_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs; no row is shuffled."""
    known = Benchmark(benchmark, item, item_text, window, max_pattern_chars)
    scanned = spare_name(docs, "__scanned")
    rows = docs.select("*", F.col(text).alias(scanned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in known.scan(batches, scanned):
            stays = batch.filter(pa.array([not ranges for _, ranges, _ in hits], pa.bool_()))
            yield pa.RecordBatch.from_arrays(stays.columns[:-1], stays.schema.names[:-1])

    return map_arrow(rows, run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
