"""Byte-level BPE encoding and decoding through one global distinct-word shuffle.

1. Tokenise: texts are cut into pre-tokens in blocks of bounded size.  A block
   keeps its distinct pre-tokens once, and the pre-token at every position as an
   index into that list; it goes to a table bucketed by block, so positions
   never cross a shuffle.
2. Distinct words: the blocks' words are dealt by word hash into bins, packed;
   a bin meets every occurrence of its words and encodes each distinct word once.
3. The ids are joined back to the words of each block, meet their block again
   by block number, and the texts are reassembled by position.
A word that is in a third of all texts costs one entry a block; a block sends a
message to each bin that has one of its words, so messages are never more than
entries.

Decoding joins token ids with the token-byte table, whose size is that of the
vocabulary file (its rows are checked against MAX_VOCABULARY) and so can be
broadcast.  ``encode`` can pass the ids of each text straight on to it.

Edge cases: null and empty texts have no tokens; a null key and repeated rows
are carried through row by row; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, bucketed, grouped, map_arrow, pack, unpack

MAX_VOCABULARY = 1 << 20
BLOCK_CHARS = 8 << 20
BLOCK_ROWS = 1 << 16
#: Entries (a distinct word of one block) that one bin holds about.
WORDS_PER_BIN = 1 << 18

_ENCODERS: dict[str, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{path} has {len(ranks)} tokens; at most {MAX_VOCABULARY} are broadcast")
    return ranks


def _encoder(vocabulary: Broadcast):
    """The BPE merger of a worker process, made once from the broadcast ranks: what it gets is one pre-token, whole."""
    import tiktoken

    name = vocabulary.value["name"]
    if name not in _ENCODERS:
        _ENCODERS.clear()  # one vocabulary a worker
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.value["ranks"], special_tokens={})
    return _ENCODERS[name].encode_ordinary


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    ranks = load_ranks(path)
    name = hashlib.sha1(pattern.encode() + b"".join(ranks)).hexdigest()
    table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        table[rank] = word
    return spark.sparkContext.broadcast({"name": name, "pattern": pattern, "ranks": ranks, "table": table})


def _tokenise(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        pack = zstandard.ZstdCompressor(level=3).compress
        part = TaskContext.get().partitionId()
        for number, held in enumerate(blocks_of(batches, BLOCK_ROWS, "text", BLOCK_CHARS)):
            index: dict[str, int] = {}
            keys: list = []
            lengths: list[int] = []
            seq: list[np.ndarray] = []
            for batch in held:
                keys.extend(batch.column("key").to_pylist())
                for text in batch.column("text").to_pylist():
                    words = find(text) if text else []
                    get = index.setdefault
                    seq.append(np.fromiter((get(w, len(index)) for w in words), np.uint32, len(words)))
                    lengths.append(len(words))
            positions = np.concatenate(seq) if seq else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 24) + number], pa.int64()),
                    pa.array([keys], pa.list_(held[0].schema.field("key").type)),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([pack(positions.tobytes())], pa.binary()),
                    pa.array([list(index)], pa.list_(pa.string())),
                    pa.array([len(index)], pa.int64()),
                ],
                ["block", "keys", "lengths", "positions", "words", "n"],
            )

    return run


def _deal_words(bins: int):
    """A block's words, packed by bin: their indexes, byte lengths and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = [w.encode() for w in words]
                home = np.fromiter((xxhash.xxh64_intdigest(w) % bins for w in data), np.int64, len(data))
                order = np.argsort(home, kind="stable")
                used, first = np.unique(home[order], return_index=True)
                rows = []
                for i, own in zip(used.tolist(), np.split(order, first[1:]), strict=True) if len(used) else ():
                    held = [data[k] for k in own.tolist()]
                    rows.append((block, i, pack(np.diff(own, prepend=0).astype(np.uint32)), pack(np.fromiter(map(len, held), np.uint32, len(held))), squeeze(b"".join(held))))
                kinds = [("block", pa.int64()), ("bin", pa.int32()), ("lids", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return run


def _encode_bin(vocab: Broadcast):
    """Each distinct word of a bin is encoded once; every block gets the ids of its words."""

    def run(table: pa.Table) -> pa.Table:
        piece = _encoder(vocab)
        known: dict[bytes, list[int]] = {}
        counts, ids = [], []
        for sizes, packed in zip(table.column("sizes").to_pylist(), table.column("bytes").to_pylist(), strict=True):
            data = zstandard.ZstdDecompressor().decompress(packed)
            ends = np.cumsum(unpack(sizes, np.uint32)).tolist()
            own, start = [], 0
            for end in ends:
                word = data[start:end]
                start = end
                found = known.get(word)
                if found is None:
                    found = known[word] = piece(word.decode())
                own.append(found)
            counts.append(pack(np.fromiter(map(len, own), np.uint32, len(own))))
            ids.append(pack(np.fromiter(itertools.chain.from_iterable(own), np.uint32)))
        return pa.table([table.column("block"), table.column("lids"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], ["home", "lids", "counts", "ids"])

    return run


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _reassemble(emit: Callable[[list], dict[str, pa.Array]]):
    """Texts put together by position; ``emit`` makes the columns beside the key from the ids of the texts of a block."""

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        lids = [np.cumsum(unpack(x, np.uint32), dtype=np.int64) for x in words.column("lids").to_pylist()]
        counts = [unpack(x, np.uint32) for x in words.column("counts").to_pylist()]
        flats = [unpack(x, np.uint32) for x in words.column("ids").to_pylist()]
        lid = np.concatenate(lids) if lids else np.zeros(0, np.int64)
        count = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        start, length = np.zeros(len(lid), np.int64), np.zeros(len(lid), np.int64)
        start[lid], length[lid] = np.cumsum(count) - count, count
        del lids, counts, flats

        def texts(row: int) -> Iterator[np.ndarray]:
            positions = unpack(block.column("positions")[row].as_py(), np.uint32)
            at = 0
            for n in block.column("lengths")[row].as_py():
                own = positions[at : at + n]
                at += n
                yield flat[_ragged(start[own], length[own])]

        keys = block.column("keys").combine_chunks().flatten()
        made = emit([x for row in range(block.num_rows) for x in texts(row)])
        return pa.table([keys, *made.values()], ["key", *made])

    return run


def _plain(texts: list[np.ndarray]) -> dict[str, pa.Array]:
    return {"ids": pa.array([x.tobytes() for x in texts], pa.binary())}


IDS = "ids binary"
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(vocab: Broadcast):
    """Counts and digests of token ids and of the bytes that they decode to."""

    def run(texts: list[np.ndarray]) -> dict[str, pa.Array]:
        table = vocab.value["table"]
        names = [b"%d" % i for i in range(len(table))]
        n, a, b = [], [], []
        for x in texts:
            ids = x.tolist()
            n.append(len(ids))
            a.append(hashlib.sha256(b",".join(map(names.__getitem__, ids))).hexdigest())
            b.append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}

    return run


def encode(docs: DataFrame, vocab: Broadcast, key: str = "doc_id", text: str = "text", words_per_bin: int = WORDS_PER_BIN, digests: bool = False) -> DataFrame:
    """One row per input row: ``key`` and ``ids``, the token ids as packed little-endian uint32.

    With ``digests`` the ids of each text are decoded where they are put
    together: ``key, n_tokens, ids_sha256, decoded_sha256``, as digest() gives.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spark = docs.sparkSession
    made = map_arrow(rows, _tokenise(vocab.value["pattern"]), f"block bigint, keys array<{kind}>, lengths array<int>, positions binary, words array<string>, n bigint")
    blocks = spark.table(bucketed(made, "block"))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    bins = max(12, -(-int(total) // words_per_bin))
    dealt = map_arrow(blocks.select("block", "words"), _deal_words(bins), "block bigint, bin int, lids binary, sizes binary, bytes binary")
    back = dealt.groupBy("bin").applyInArrow(grouped(_encode_bin(vocab)), "home bigint, lids binary, counts binary, ids binary")
    texts = blocks.select("block", "keys", "lengths", "positions").groupBy("block")
    emit, columns = (_digests(vocab), DIGESTS) if digests else (_plain, IDS)
    return texts.cogroup(back.groupBy("home")).applyInArrow(grouped(_reassemble(emit)), f"key {kind}, {columns}").withColumnRenamed("key", key)


def decode_ids(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, np.uint32).tolist()))


def decode(encoded: DataFrame, vocab: Broadcast, key: str = "doc_id") -> DataFrame:
    """``key`` and ``content``: the bytes of the ids, by a map-side join with the token-byte table."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocab.value["table"]
        for batch in batches:
            content = [decode_ids(x or b"", table) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], [key, "content"])

    return map_arrow(encoded.select(key, "ids"), run, f"{key} {kind}, content binary")


def digest(encoded: DataFrame, vocab: Broadcast, key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of encoded rows."""
    kind = encoded.schema[key].dataType.simpleString()
    made = _digests(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = made([np.frombuffer(x or b"", np.uint32) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.values()], [key, *out])

    return map_arrow(encoded.select(key, "ids"), run, f"{key} {kind}, {DIGESTS}")
