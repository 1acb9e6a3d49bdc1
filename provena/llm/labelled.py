"""Labelled rows, sums over all of them, and the fits shared by the two classifiers.

Models are learned from every labelled row outside the held-out fold.  A fit is
a number of passes over the rows, each of which sums whole numbers (values are
rounded to 2**-SCALE_BITS), so that a result depends neither on how the rows are
dealt out nor on where they are summed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, likely, map_arrow, materialise, pack, unpack

#: Up to so many rows are summed on the driver, more by tasks; the sums are the same.
LOCAL_ROWS = 10_000
SCALE_BITS = 30
SCALE = 1 << SCALE_BITS


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``, is ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, key: str = "doc_id", text: str = "text", made: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(text, y) of every labelled row outside the held-out fold.

    Only rows that are likely to be labelled are shuffled; ``made`` turns their
    (id, text) into (id, text) with something shorter for the text before that.
    The plan is the same for every size: labels are never broadcast whole.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key, modulus, remainder)).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"))
    rows = docs.where(F.col(key).isNotNull() & ~held_out(key, modulus, remainder)).select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = likely(rows, known, "id")
    chosen = known.groupBy("id").agg(F.max("y").alias("y"))
    return (made(rows) if made else rows).join(chosen.hint("shuffle_hash"), "id").select("text", "y")


class Rows:
    """Training rows as blocks of arrays, in a table or (few of them) on the driver."""

    def __init__(self, table: DataFrame | None, blocks: list[tuple] | None):
        self.table, self.blocks = table, blocks

    @classmethod
    def of(cls, df: DataFrame, make: Callable[[pa.RecordBatch], tuple], tag: str, local_rows: int | None = None) -> Rows:
        """One block of arrays for every batch of ``df``, each row read once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    block = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(make(batch)))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([block], pa.binary())], ["n", "block"])

        table = materialise(map_arrow(df, run, "n bigint, block binary"), tag)
        n = table.agg(F.sum("n").alias("n")).first()["n"] or 0
        if n > (LOCAL_ROWS if local_rows is None else local_rows):
            return cls(table.select("block"), None)
        blocks = [cls.block(r["block"]) for r in table.select("block").collect()]
        discard(table)
        return cls(None, blocks)

    def drop(self) -> None:
        """Deletes the table, once nothing is to be summed any more."""
        if self.table is not None:
            discard(self.table)

    @staticmethod
    def block(data: bytes) -> tuple:
        return pickle.loads(zstandard.ZstdDecompressor().decompress(data))

    def sums(self, fn: Callable[..., np.ndarray], size: int) -> np.ndarray:
        """The sum of ``fn(*block)``, ``size`` whole numbers, over all blocks."""
        total = np.zeros(size, np.int64)
        if self.table is None:
            for block in self.blocks:
                total += fn(*block)
            return total
        open_block = self.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size, np.int64)
            for batch in batches:
                for data in batch.column(0):
                    out += fn(*open_block(data.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([pack(out)], pa.binary())], ["sums"])

        for r in map_arrow(self.table, run, "sums binary").collect():  # packed, one a task
            total += unpack(r["sums"], np.int64)
        return total


def whole(values: np.ndarray) -> np.ndarray:
    """Values as multiples of 2**-SCALE_BITS; they stay floats, whose sums are exact up to 2**53."""
    return np.rint(values * SCALE)


def _sortable(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the floats."""
    u = (np.ascontiguousarray(v, np.float64) + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def _floats(k: np.ndarray) -> np.ndarray:
    return np.where(k >> np.uint64(63), k & np.uint64((1 << 63) - 1), ~k).view(np.float64)


def order_statistics(rows: Rows, values: Callable[..., list[np.ndarray]], ranks: list[np.ndarray]) -> list[np.ndarray]:
    """The values of the given ranks (from 0) of each of the lists ``values(*block)``, over all rows.

    Eight passes fix eight bits each; a pass counts the next bits under the
    prefixes that the ranks have reached.
    """
    prefix, left = [np.zeros(len(r), np.uint64) for r in ranks], [np.array(r, np.int64) for r in ranks]
    for shift in range(56, -1, -8):
        known = [np.unique(p) for p in prefix]
        at = np.cumsum([0, *map(len, known)])

        def count(*block, known=known, at=at, shift=shift) -> np.ndarray:
            out = np.zeros((at[-1], 256), np.int64)
            for c, v in enumerate(values(*block)):
                k = _sortable(v)
                top = k >> np.uint64(shift + 8) if shift < 56 else np.zeros_like(k)
                if not len(known[c]):
                    continue
                j = np.minimum(np.searchsorted(known[c], top), len(known[c]) - 1)
                own = known[c][j] == top
                digit = ((k[own] >> np.uint64(shift)) & np.uint64(255)).astype(np.int64)
                out[at[c] : at[c + 1]] += np.bincount(j[own] * 256 + digit, minlength=256 * len(known[c])).reshape(-1, 256)
            return out.ravel()

        found = rows.sums(count, int(at[-1]) * 256).reshape(-1, 256).cumsum(axis=1)
        for c in range(len(ranks)):
            for i in range(len(ranks[c])):
                upto = found[at[c] + np.searchsorted(known[c], prefix[c][i])]
                digit = int(np.searchsorted(upto, left[c][i], side="right"))
                left[c][i] -= upto[digit - 1] if digit else 0
                prefix[c][i] = (prefix[c][i] << np.uint64(8)) | np.uint64(digit)
    return [_floats(p) for p in prefix]


def quantiles(rows: Rows, values: Callable[..., list[np.ndarray]], sizes: list[int], shares: list[np.ndarray]) -> list[np.ndarray]:
    """Quantiles of each list as numpy.quantile has them; ``sizes`` are the lengths of the lists over all rows."""
    spots = [np.asarray(q, float) * (n - 1) for q, n in zip(shares, sizes, strict=True)]
    low = [np.floor(s).astype(np.int64) for s in spots]
    found = order_statistics(rows, values, [np.concatenate([a, np.minimum(a + 1, n - 1)]) for a, n in zip(low, sizes, strict=True)])
    return [x[: len(a)] + (x[len(a) :] - x[: len(a)]) * (s - a) for x, a, s in zip(found, low, spots, strict=True)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 100, memory: int = 10, flat: float = 1e-6) -> np.ndarray:
    """L-BFGS with halved steps, for a convex function given by its value and gradient."""
    w = start.copy()
    f, g = evaluate(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if not len(w) or np.abs(g).max() <= flat:
            break
        d, held = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            held.append(a)
            d = d - a * y
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(g))
        for (s, y), a in zip(past, reversed(held), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        t = 1.0
        while True:
            f2, g2 = evaluate(w + t * d)
            if f2 <= f + 1e-4 * t * (g @ d):
                break
            t /= 2
            if t < 1e-4:
                return w
        s, y = t * d, g2 - g
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        small, w, f, g = f - f2 <= 1e-6 * f, w + s, f2, g2
        if small:
            break
    return w
