"""Substring dedup with a log-structured fingerprint index.

A window is ``window`` consecutive words.  Every window is represented by one
of its ``gram``-word hashes, the leftmost smallest (winnowing): equal windows
always choose equal hashes, and only about one position in seven is chosen.

* Index: sorted immutable runs of the hashes of all documents so far, cut into
  bins by hash.  A new batch becomes a run; it is merge-joined with the older
  runs, which yields the hashes that occur more than once; when more than
  ``max_runs`` runs exist they are merged into one (compaction).  A folder holds
  the runs, each session's blocks and their hashes, and a numbered manifest that
  names them and appears whole; a session that fails leaves the manifest as it
  was.  ``SubstringIndex`` opens the folder again, and adds further documents to
  what it knows.
* Verification: only windows whose chosen hash is shared are sent on, with a
  128-bit hash of all their words; per distinct window the earliest start
  (earlier session, then smallest document, then smallest position) is found,
  every other occurrence covers words to remove.  Of earlier sessions only
  blocks with a shared hash are read.

Texts stay where they are: they are written once, compressed, as a table
bucketed by block, and the rounds join only bits to it.  Inside a block a
repeated hash is sent once, so one passage in a third of all documents costs
one entry a block.

Edge cases: null and empty texts have no words; documents shorter than a window
keep all words; exact copies lose all words of full windows; a null key sorts
before all others; rows repeated under one key are ordered by their place in
the table; further columns are ignored; an empty table gives an empty result.
Keys are whole numbers, as they are ordered by them; others raise a TypeError.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, bucketed, fresh_dir, grouped, map_arrow, materialise, pack, unpack
from .words import U, chunks, doc_words, mix, window_hash

WINDOW = 20
GRAM = 8
BATCHES = 4
MAX_RUNS = 2
WORDS_PER_BIN = 1 << 20
BLOCK_CHARS = 5 << 20
SECOND_BASE = 0xC2B2AE3D27D4EB4F | 1
NULL_KEY = -(1 << 63)


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted uint64 values: differences, split into byte planes, compressed."""
    d = np.diff(a, prepend=U(0))
    return pack(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def leftmost_minimum(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of every ``width`` consecutive values."""
    v, p, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        a, b = v[: len(v) - step], v[step:]
        right = b < a
        v, p = np.where(right, b, a), np.where(right, p[step:], p[: len(p) - step])
        have += step
    return p


class Block:
    """Words, windows and chosen hashes of one block of documents."""

    def __init__(self, texts: list[bytes], window: int, gram: int, full: bool = True):
        self.counts, anchors, owner, starts, wins, wins2, docs = [], [], [], [], [], [], []
        first_doc = n_anchor = 0
        for lo, hi in chunks(texts):
            h, _, _, counts = doc_words(texts[lo:hi])
            self.counts.append(counts)
            ends = np.cumsum(counts)
            doc = np.repeat(np.arange(hi - lo), counts)
            n = len(h) - window + 1
            if n > 0:
                at = np.arange(n)
                ok = at + window <= ends[doc[:n]]
                g = window_hash(h, gram)
                best = leftmost_minimum(g, window - gram + 1)[:n][ok]
                at = at[ok]
                new = np.concatenate(([True], best[1:] != best[:-1])) if len(best) else np.zeros(0, bool)
                anchors.append(mix(g[best[new]]))  # minima are small numbers; mixed, they fill all bins alike
                owner.append(np.cumsum(new) - 1 + n_anchor)
                n_anchor += int(new.sum())
                if full:
                    starts.append((at - (ends - counts)[doc[at]]).astype(np.uint32))
                    docs.append((doc[at] + first_doc).astype(np.uint32))
                    wins.append(window_hash(h, window)[at])
                    wins2.append(window_hash(h, window, SECOND_BASE)[at])
            first_doc += hi - lo
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.counts = cat(self.counts, np.int64)
        self.anchors = cat(anchors, U)
        self.owner = cat(owner, np.int64)
        self.starts, self.docs, self.win, self.win2 = cat(starts, np.uint32), cat(docs, np.uint32), cat(wins, U), cat(wins2, U)


def bin_of(h: np.ndarray, bins: int) -> np.ndarray:
    return ((h >> U(32)) * U(bins)) >> U(32)


def by_bin(h: np.ndarray, bins: int) -> Iterator[tuple[int, slice]]:
    """The bins of sorted hashes and where each has its own; never more of them than hashes."""
    used, first = np.unique(bin_of(h, bins), return_index=True)
    for where, a, b in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(h)], strict=True):
        yield where, slice(a, b)


def split_text(row: dict) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(row["text"])
    ends = np.cumsum(np.asarray(row["sizes"], np.int64)) if row["sizes"] else []
    return [data[b - n : b] for b, n in zip(ends, row["sizes"], strict=True)]


def _make_blocks(session: int):
    """Blocks are numbered by session, task and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (session << 48) + (TaskContext.get().partitionId() << 24)
        deflate = zstandard.ZstdCompressor(level=6).compress
        for number, held in enumerate(blocks_of(batches, 1 << 16, "text", BLOCK_CHARS)):
            keys, texts = [], []
            for batch in held:
                keys += batch.column("key").to_pylist()
                texts += [t or b"" for t in batch.column("text").to_pylist()]
            words = sum(len(t) for t in texts) // 4  # an estimate that only sizes the bins
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + number], pa.int64()), pa.array([words], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([deflate(b"".join(texts))], pa.binary()),
                ],
                ["block", "words", "keys", "sizes", "text"],
            )

    return run


class Blocks:
    """The documents, compressed, in a table bucketed by block: later rounds join to it without moving texts."""

    schema = "block bigint, words bigint, keys array<bigint>, sizes array<int>, text binary"

    def __init__(self, docs: DataFrame, key: str, text: str, path: str | None = None, session: int = 0):
        self.spark = docs.sparkSession
        kind = docs.schema[key].dataType.simpleString()
        if kind not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{key} is {kind}: documents are ordered by a whole number")
        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
        self.name = bucketed(map_arrow(rows, _make_blocks(session), self.schema), "block", "none", path)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)


def anchors_of(blocks: DataFrame, bins: int, window: int, gram: int) -> DataFrame:
    """(block, bin, repeated, hashes): the block's distinct chosen hashes, sorted, and which it has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(split_text(row), window, gram, full=False)
                h, n = np.unique(b.anchors, return_counts=True)
                use = list(by_bin(h, bins))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(use), pa.int64()), pa.array([i for i, _ in use], pa.int32()),
                        pa.array([pack(np.packbits(n[own] > 1)) for _, own in use], pa.binary()),
                        pa.array([pack_sorted(h[own]) for _, own in use], pa.binary()),
                    ],
                    ["block", "bin", "repeated", "hashes"],
                )

    return map_arrow(blocks.select("block", "sizes", "text"), run, "block bigint, bin int, repeated binary, hashes binary")


def _sort_batch(table: pa.Table) -> pa.Table:
    """A batch's entries of one bin as one sorted run, with the hashes that it has more than once."""
    parts, twice = [], []
    for h, r in zip(table.column("hashes").to_pylist(), table.column("repeated").to_pylist(), strict=True):
        own = unpack_sorted(h)
        parts.append(own)
        twice.append(own[np.unpackbits(unpack(r, np.uint8), count=len(own)).astype(bool)])
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    shared = np.union1d(h[n > 1], np.concatenate(twice))
    return pa.table([pa.array([table.column("bin")[0].as_py()], pa.int32()), pa.array([pack_sorted(h)], pa.binary()), pa.array([pack_sorted(shared)], pa.binary())], ["bin", "hashes", "shared"])


def _merge_join(new: pa.Table, runs: pa.Table) -> pa.Table:
    """Hashes of a new run that an older run has too: sorted arrays against sorted arrays."""
    out: list[np.ndarray] = [np.zeros(0, U)]
    where = (new if new.num_rows else runs).column("bin" if new.num_rows else "at")[0].as_py()
    for a in new.column("hashes").to_pylist():
        h = unpack_sorted(a)
        for b in runs.column("hashes").to_pylist():
            old = unpack_sorted(b)
            if len(old) and len(h):
                pos = np.minimum(np.searchsorted(old, h), len(old) - 1)
                out.append(h[old[pos] == h])
    return pa.table([pa.array([where], pa.int32()), pa.array([pack_sorted(np.unique(np.concatenate(out)))], pa.binary())], ["bin", "shared"])


def _compact(table: pa.Table) -> pa.Table:
    merged = np.unique(np.concatenate([unpack_sorted(h) for h in table.column("hashes").to_pylist()]))
    return pa.table([pa.array([table.column("bin")[0].as_py()], pa.int32()), pa.array([pack_sorted(merged)], pa.binary())], ["bin", "hashes"])


class FingerprintIndex:
    """A folder of sorted immutable runs of chosen hashes, and of the sessions that they come from; its manifest says which count.

    ``bins`` holds for the life of the folder: give a new one the number that
    the corpus will need.
    """

    def __init__(self, spark: SparkSession, bins: int | None = None, max_runs: int = MAX_RUNS, path: str | None = None, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.max_runs, self.dead = spark, max_runs, []
        self.path = path or fresh_dir(spark, "index")
        self.store, self.root = fs.FileSystem.from_uri(self.path)
        found = self._manifests()
        if found:
            with self.store.open_input_stream(f"{self.root}/{found[-1]}") as f:
                self.state = json.loads(f.read())
            if bins not in (None, self.state["bins"]) or (window, gram) != (self.state["window"], self.state["gram"]):
                raise ValueError(f"{self.path} was made for other bins, windows or hashes")
        else:
            self.state = {"bins": bins, "window": window, "gram": gram, "runs": [], "sessions": []}

    @property
    def bins(self) -> int:
        return self.state["bins"]

    @property
    def runs(self) -> list[str]:
        return self.state["runs"]

    def _manifests(self) -> list[str]:
        if self.store.get_file_info(self.root).type == fs.FileType.NotFound:
            return []
        found = (f.base_name for f in self.store.get_file_info(fs.FileSelector(self.root)))
        return sorted(f for f in found if f.startswith("manifest-") and f.endswith(".json"))

    def commit(self) -> None:
        """The next manifest; runs that were compacted are deleted after it."""
        name = f"manifest-{len(self._manifests()) + 1:08d}.json"
        self.store.create_dir(self.root, recursive=True)
        with self.store.open_output_stream(f"{self.root}/{name}.tmp") as f:
            f.write(json.dumps(self.state).encode())
        self.store.move(f"{self.root}/{name}.tmp", f"{self.root}/{name}")
        while self.dead:
            self.store.delete_dir(f"{self.root}/{self.dead.pop()}")

    def new(self, tag: str) -> str:
        return f"{tag}-{uuid.uuid4().hex}"

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def write(self, df: DataFrame, tag: str) -> str:
        name = self.new(tag)
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _all(self) -> DataFrame:
        return self.spark.read.schema("bin int, hashes binary").parquet(*(f"{self.path}/{r}" for r in self.runs))

    def ingest(self, anchors: DataFrame) -> DataFrame:
        """Add a batch; returns (bin, shared) rows: hashes that now occur more than once."""
        name = self.write(anchors.groupBy("bin").applyInArrow(grouped(_sort_batch), "bin int, hashes binary, shared binary"), "run")
        run = self.table(name, "bin int, hashes binary, shared binary")
        found = run.select("bin", "shared")
        if self.runs:
            old = self._all().select(F.col("bin").alias("at"), "hashes").groupBy("at")
            joined = run.select("bin", "hashes").groupBy("bin").cogroup(old).applyInArrow(grouped(_merge_join), "bin int, shared binary")
            found = found.unionByName(materialise(joined, "hits"))
        found = materialise(found, "shared")  # runs may go when the index is compacted
        self.runs.append(name)
        if len(self.runs) > self.max_runs:
            self.compact()
        self.commit()
        return found

    def compact(self) -> None:
        """One run of all hashes in place of all runs, which go with the next manifest."""
        self.dead += self.runs
        self.state["runs"] = [self.write(self._all().groupBy("bin").applyInArrow(grouped(_compact), "bin int, hashes binary"), "compacted")]


def _flag_anchors(only_hits: bool):
    """One bit for each hash a block has in this bin: shared or not; ``only_hits``: only for blocks that have a shared one."""

    def run(asked: pa.Table, shared: pa.Table) -> pa.Table:
        have = [unpack_sorted(s) for s in shared.column("shared").to_pylist()]
        have = np.unique(np.concatenate(have)) if have else np.zeros(0, U)
        blocks, bins, bits = [], [], []
        for block, where, h in zip(asked.column("block").to_pylist(), asked.column("bin").to_pylist(), asked.column("hashes").to_pylist(), strict=True):
            h = unpack_sorted(h)
            hit = have[np.minimum(np.searchsorted(have, h), len(have) - 1)] == h if len(have) else np.zeros(len(h), bool)
            if only_hits and not hit.any():
                continue
            blocks.append(block)
            bins.append(where)
            bits.append(pack(np.packbits(hit)))
        return pa.table([pa.array(blocks, pa.int64()), pa.array(bins, pa.int32()), pa.array(bits, pa.binary())], ["home", "bin", "bits"])

    return run


def _bits(replies: pa.Table, keys: np.ndarray, bins: int) -> np.ndarray:
    """The replies to hashes ``keys`` (sorted by hash, so by bin) put together again; bins without a reply have none."""
    out = np.zeros(len(keys), bool)
    spans = dict(by_bin(keys, bins))
    for where, bits in zip(replies.column("bin").to_pylist(), replies.column("bits").to_pylist(), strict=True):
        own = spans[where]
        out[own] = np.unpackbits(unpack(bits, np.uint8), count=own.stop - own.start).astype(bool)
    return out


def _keys(row: dict) -> np.ndarray:
    return np.asarray([NULL_KEY if k is None else k for k in row["keys"]], np.int64)


class Candidates:
    """Windows of a block whose chosen hash is shared; per distinct window the block's earliest stands for the rest."""

    def __init__(self, row: dict, replies: pa.Table, bins: int, window: int, gram: int):
        self.block = b = Block(split_text(row), window, gram)
        h, inverse = np.unique(b.anchors, return_inverse=True)
        flagged = _bits(replies, h, bins)[inverse] if len(h) else np.zeros(0, bool)
        self.at = np.flatnonzero(flagged[b.owner]) if len(b.owner) else np.zeros(0, np.int64)
        self.keys = _keys(row)
        # By window, then document, then place in the block, then start: the first of each window stands for it.
        order = np.lexsort((b.starts[self.at], b.docs[self.at], self.keys[b.docs[self.at]], b.win2[self.at], b.win[self.at]))
        self.at = self.at[order]
        w, v = b.win[self.at], b.win2[self.at]
        self.lead = np.concatenate(([True], (w[1:] != w[:-1]) | (v[1:] != v[:-1]))) if len(w) else np.zeros(0, bool)


def _send_windows(bins: int, window: int, gram: int):
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        for row in block.to_pylist():
            c = Candidates(row, replies, bins, window, gram)
            at, b = c.at[c.lead], c.block
            for i, span in by_bin(b.win[at], bins):
                own = at[span]
                doc = b.docs[own].astype(np.int64)
                used, inverse = np.unique(doc, return_inverse=True)
                rows.append((row["block"], i, pack_sorted(b.win[own]), b.win2[own].tobytes(), pack(inverse.astype(np.uint32)), pack(c.keys[used]), pack(used.astype(np.uint32)), pack(b.starts[own])))
        names = [("block", pa.int64()), ("bin", pa.int32()), ("win", pa.binary()), ("win2", pa.binary()), ("doc", pa.binary()), ("keys", pa.binary()), ("place", pa.binary()), ("start", pa.binary())]
        return pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(names)], [n for n, _ in names])

    return run


def _earliest(table: pa.Table) -> pa.Table:
    """Per distinct window of a bin, every sender but the earliest learns that its window starts earlier elsewhere.

    Earlier sessions come first, then smaller keys; the number of a block begins with its session.
    """
    rows = table.to_pylist()
    w, v, key, place, start, sender = [], [], [], [], [], []
    for i, r in enumerate(rows):
        own = unpack_sorted(r["win"])
        doc = unpack(r["doc"], np.uint32)
        w.append(own)
        v.append(np.frombuffer(r["win2"], U))
        key.append(unpack(r["keys"], np.int64)[doc])
        place.append(unpack(r["place"], np.uint32)[doc])
        start.append(unpack(r["start"], np.uint32))
        sender.append(np.full(len(own), i, np.int32))
    sizes = [len(x) for x in w]
    block = np.repeat(np.asarray([r["block"] for r in rows], np.int64), sizes)
    w, v, key, place, start = (np.concatenate(x) for x in (w, v, key, place, start))
    order = np.lexsort((start, place, block, key, block >> 48, v, w))
    a, b = w[order], v[order]
    later = np.zeros(len(order), bool)
    later[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    ends = np.cumsum(sizes)
    bits = [pack(np.packbits(later[e - n : e])) for e, n in zip(ends, sizes, strict=True)]
    return pa.table([pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["bin"] for r in rows], pa.int32()), pa.array(bits, pa.binary()), pa.array(["later"] * len(rows))], ["home", "bin", "bits", "kind"])


def _finish(bins: int, window: int, gram: int):
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = np.asarray(replies.column("kind").to_pylist())
        keys, n_words, spans, texts = [], [], [], []
        for row in block.to_pylist():
            anchors = replies.filter(pa.array(kinds == "anchor"))
            later = replies.filter(pa.array(kinds == "later"))
            c = Candidates(row, anchors, bins, window, gram)
            b = c.block
            flags = np.ones(len(c.at), bool)  # all but the block's earliest start earlier within the block
            flags[c.lead] = _bits(later, b.win[c.at[c.lead]], bins)
            hit = c.at[flags]
            base = np.concatenate(([0], np.cumsum(b.counts)))
            cover = np.zeros(base[-1] + 1, np.int64)
            first = base[b.docs[hit]] + b.starts[hit]
            np.add.at(cover, first, 1)
            np.add.at(cover, first + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            keys += row["keys"]
            for d, text in enumerate(split_text(row)):
                own = gone[base[d] : base[d + 1]]
                n_words.append(len(own))
                edge = np.diff(np.concatenate(([0], own.astype(np.int8), [0])))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                words = [] if len(own) and own.all() else text.split()  # bytes.split() cuts at [\x20\x09-\x0D]
                texts.append(b" ".join(w for w, g in zip(words, own.tolist(), strict=True) if not g) if words and own.any() else b" ".join(words))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(keys, pa.int64()), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(texts, pa.binary())], ["key", "n_words", "removed", "kept"])

    return run


SENT = "block bigint, bin int, win binary, win2 binary, doc binary, keys binary, place binary, start binary"
ANCHORS = "block bigint, bin int, repeated binary, hashes binary"


class SubstringIndex(FingerprintIndex):
    """Documents of any number of sessions, of which each is cleared of what it or an earlier one has already."""

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, words_per_bin: int = WORDS_PER_BIN) -> DataFrame:
        """``key, n_words, removed`` (word ranges, end exclusive) and ``kept`` (UTF-8 of the kept words) of every row."""
        window, gram, old = self.state["window"], self.state["gram"], list(self.state["sessions"])
        session = len(old)
        place = self.new("blocks")
        blocks = Blocks(docs, key, text, f"{self.path}/{place}", session)
        if self.bins is None:
            total = blocks.table.agg(F.sum("words")).first()[0] or 0
            self.state["bins"] = max(12, -(-int(total) // words_per_bin))
        bins = self.bins
        anchors = self.write(anchors_of(blocks.table, bins, window, gram), "anchors")
        asked = self.table(anchors, ANCHORS)
        shared = None
        for k in range(batches):
            found = self.ingest(asked.where(F.pmod(F.xxhash64("block"), F.lit(batches)) == k))
            shared = found if shared is None else shared.unionByName(found)
        self.state["sessions"].append({"blocks": place, "anchors": anchors})
        self.commit()
        by_hash = shared.select(F.col("bin").alias("at"), "shared").groupBy("at")
        flagged = lambda table, only: materialise(table.select("block", "bin", "hashes").groupBy("bin").cogroup(by_hash).applyInArrow(grouped(_flag_anchors(only)), "home bigint, bin int, bits binary"), "flags")
        send = lambda table, flags: table.groupBy("block").cogroup(flags.groupBy("home")).applyInArrow(grouped(_send_windows(bins, window, gram)), SENT)
        flags = flagged(asked, False)
        sent = send(blocks.table, flags)
        for s in old:  # of earlier sessions, only blocks that have a shared hash
            hits = flagged(self.table(s["anchors"], ANCHORS), True)
            known = self.table(s["blocks"], Blocks.schema).join(hits.select(F.col("home").alias("block")).distinct(), "block", "left_semi")
            sent = sent.unionByName(send(known, hits))
        later = sent.groupBy("bin").applyInArrow(grouped(_earliest), "home bigint, bin int, bits binary, kind string")
        later = materialise(later.where(F.shiftright("home", 48) == session), "later")
        replies = flags.withColumn("kind", F.lit("anchor")).unionByName(later)
        out = blocks.table.groupBy("block").cogroup(replies.groupBy("home")).applyInArrow(
            grouped(_finish(bins, window, gram)), "key bigint, n_words bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
        )
        return out.withColumnRenamed("key", key)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, words_per_bin: int = WORDS_PER_BIN, path: str | None = None) -> DataFrame:
    """``key, n_words, removed, kept`` of every row, by the index in ``path``, or by a new one."""
    return SubstringIndex(docs.sparkSession, path=path, window=window, gram=gram).add(docs, key, text, batches, words_per_bin)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(key, "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))

