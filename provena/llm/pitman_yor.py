"""Language-model scoring by a hierarchical Pitman-Yor model of words.

Every word that occurs as a predecessor is a context with a restaurant of its
own; all context restaurants share one parent, the restaurant without context.
The parent's customers are the tables of the context restaurants; its base
hands out new words only, so each of its dishes has one table.  A word outside
the training rows is one unknown word, the event that the base is drawn from.

Seating is sampled by Gibbs, both levels in turn.  In a sweep the customers of
every dish of every context sit down anew, one after another, given the tables
that their restaurant had and the parent's predictive probability of the dish;
the tables that they open and close are the parent's customers at once, before
the next sweep.  So that bins can work side by side, a sweep uses the state
that the sweep before left everywhere, its own dish included; this is the usual
synchronous form, not a sampler that takes customers out one by one.  The
predictive probability of a pair is averaged over SAMPLES sweeps after BURN_IN:
the mean of (c - d t + (s + d T) p(word)) / (s + C), with c customers and t
tables of the dish, C and T of the restaurant.  A text's score is the sum of
the log10 of those of its words and its end.

Hyperparameters: discount DISCOUNT and strength STRENGTH in the contexts,
strength STRENGTH in the parent, whose discount is n1 / (n1 + 2 n2) by the
words that follow one and two different contexts.

How it runs:

* Texts are cut into blocks; a block keeps its words once and the word at every
  position as an index, in a table bucketed by block that never moves again.
* Blocks' words go to bins by hash, which number them and sum up training
  counts; a word is known by that number from then on, so no two are confused.
* Each block sends its distinct (context, word) pairs to bins by context, which
  hold the restaurants.  In every sweep bins of contexts send the tables of each
  word to the words' bins, which answer with the parent's customers.  At last
  bins of both kinds answer the blocks, which add up their texts.
* Everything gathered stays distributed.  A frequent pair costs one entry a
  block, a frequent word one entry a bin.  The restaurant of a context with more
  than a 4096th of all tokens is dealt over bins of its own by word; what a
  sweep needs of the whole restaurant is its number of tables, one number for
  each of the at most 4096 such contexts, summed up after every sweep.
* A block loops over the bins that it has words for, never over all bins.

Edge cases: null and empty texts have one token, the end; with no training rows
every word is unknown, with probability 1; repeated rows count as often as they
occur; a null key is a training row; further columns are ignored.  Keys are of
any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import blocks_of, bucketed, grouped, map_arrow, materialise, pack, unpack
from .labelled import held_out
from .words import U, mix

BLOCK_CHARS = 8 << 20
WORDS_PER_BIN = 1 << 18
PAIRS_PER_BIN = 1 << 20
BURN_IN, SAMPLES = 1, 3
DISCOUNT, STRENGTH = 0.7, 1.0
#: A context is dealt over several bins from this many tokens on (and from a 4096th of all tokens on).
LEAST_HOT, HOT_SHARE = 1 << 18, 4096
SEED = 11
LOW = U(0xFFFFFFFF)


# --- Seating -----------------------------------------------------------------


def seat(c: np.ndarray, alpha: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after c customers of each dish have sat down one after another.

    A customer opens a table with weight alpha (the restaurant's base mass for
    the dish) against i - d * tables.  From the 32nd on, customers sit down in
    groups of a sixteenth of those seated, so that a dish with any number of
    customers takes a few hundred steps.
    """
    out = np.zeros(len(c), np.int64)
    order = np.argsort(-c, kind="stable")
    c, alpha = c[order], alpha[order]
    n = int(np.searchsorted(-c, 0))  # dishes with customers
    t = np.ones(n, np.int64)
    i = 1
    n = int(np.searchsorted(-c[:n], -i))
    while n:
        m = max(1, i // 16)
        a = alpha[:n]
        t[:n] += rng.binomial(np.minimum(c[:n] - i, m), a / (a + i - d * np.minimum(t[:n], i)))
        i += m
        n = int(np.searchsorted(-c[:n], -i))
    out[order[: len(t)]] = np.minimum(t, c[: len(t)])
    return out


class Parent:
    """The parent restaurant's predictive probabilities, from its customers of a word and in all."""

    def __init__(self, customers: int, types: int, discount: float):
        self.total, self.discount = STRENGTH + customers, discount
        self.unknown = (STRENGTH + discount * types) / self.total

    def __call__(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, (n - self.discount) / self.total, self.unknown)


def sweep(c: np.ndarray, number: np.ndarray, tables: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of every dish after its customers have sat down anew.

    ``number``: the restaurant of each dish; ``tables``: those of every
    restaurant before; ``p``: the parent's probability of each dish.
    """
    t = np.minimum(c, 1)
    many = np.flatnonzero(c > 1)  # others have as many tables as customers
    t[many] = seat(c[many], (STRENGTH + DISCOUNT * tables[number[many]]) * p[many], DISCOUNT, rng)
    return t


# --- Packing -----------------------------------------------------------------


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return pack(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(sizes: bytes, data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(unpack(sizes, np.uint32)).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def pack_ids(a: np.ndarray) -> bytes:
    """uint64 values: differences (modulo 2**64) in byte planes, compressed."""
    d = np.diff(a.astype(U), prepend=U(0))
    return pack(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T))


def unpack_ids(b: bytes) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def pack_numbers(a: np.ndarray) -> bytes:
    """Counts in as many byte planes as the largest needs, compressed; the first byte is their number."""
    k = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([k]) + pack(np.ascontiguousarray(a.astype(U).view(np.uint8).reshape(-1, 8)[:, :k].T))


def unpack_numbers(b: bytes) -> np.ndarray:
    planes = unpack(b[1:], np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view(np.int64).ravel()


def runs(a: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The equal neighbours of a sorted array."""
    values, first = np.unique(a, return_index=True)
    for value, start, end in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(a)], strict=True):
        yield value, slice(start, end)


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(columns)], [n for n, _ in columns])


# --- Blocks and words --------------------------------------------------------


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for number, held in enumerate(blocks_of(batches, 1 << 16, "text", BLOCK_CHARS)):
        index: dict[bytes, int] = {b"": 0}  # the end of a text is the empty word
        keys, lengths, seq, train = [], [], [], []
        for batch in held:
            keys += batch.column("key").to_pylist()
            train += batch.column("train").to_pylist()
            get = index.setdefault
            for text in batch.column("text").to_pylist():
                words = text.lower().split() if text else []  # of bytes: A-Z only, cut at [\x20\x09-\x0D]
                own = np.zeros(len(words) + 1, np.uint32)
                own[:-1] = [get(w, len(index)) for w in words]
                seq.append(own)
                lengths.append(len(own))
        every = np.concatenate(seq)
        counts = np.bincount(every[np.repeat(np.asarray(train, bool), lengths)], minlength=len(index))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 24) + number], pa.int64()), pa.array([keys], pa.list_(held[0].schema.field("key").type)), pa.array([train], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int32())), pa.array([pack(every, 3)], pa.binary()),
                pa.array([list(index)], pa.list_(pa.binary())), pa.array([pack(counts.astype(np.int64))], pa.binary()), pa.array([len(index)], pa.int64()), pa.array([len(every)], pa.int64()),
            ],
            ["block", "keys", "train", "lengths", "positions", "words", "counts", "n", "tokens"],
        )


_DEALT = "block bigint, bin int, lids binary, sizes binary, bytes binary, counts binary"


def _deal(bins: int):
    """A block's words, packed by bin: their indexes, byte lengths, bytes and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = unpack(counts, np.int64)
                home = np.fromiter((xxhash.xxh64_intdigest(w) % bins for w in words), np.int64, len(words))
                order = np.argsort(home, kind="stable")
                rows = []
                for i, at in runs(home[order]):
                    own = order[at]
                    rows.append((block, i, pack(np.diff(own, prepend=0).astype(np.uint32)), *pack_words([words[k] for k in own.tolist()]), pack_numbers(counts[own])))
                yield from table_of(_DEALT, rows).to_batches()

    return run


_VOCABULARY = "bin int, home bigint, lids binary, places binary, counts binary, types bigint, tokens bigint"


def _vocabulary(table: pa.Table) -> pa.Table:
    """For every block the numbers of its words in a bin and their training counts; the bin's sums in a row without a block."""
    index: dict[bytes, int] = {}
    asks, total = [], []
    get = index.setdefault
    for row in sorted(table.to_pylist(), key=lambda r: r["block"]):  # so that a bin that is made again numbers its words alike
        words = unpack_words(row["sizes"], row["bytes"])
        own = np.fromiter((get(w, len(index)) for w in words), np.int64, len(words))
        total.append((own, unpack_numbers(row["counts"])))
        asks.append((row["block"], row["lids"], own))
    counts = np.zeros(len(index), np.int64)
    for own, n in total:
        counts[own] += n  # a block has a word once
    where = table.column("bin")[0].as_py()
    rows = [(where, None, None, None, None, int((counts > 0).sum()), int(counts.sum()))]
    rows += [(where, block, lids, pack_ids(own), pack_numbers(counts[own]), None, None) for block, lids, own in asks]
    return table_of(_VOCABULARY, rows)


def gather(replies: list[dict], column: str, n: int, unpacked=unpack_numbers) -> np.ndarray:
    """Values that word bins sent to a block, by word index."""
    out = np.zeros(n, np.int64)
    for r in replies:
        out[np.cumsum(unpack(r["lids"], np.uint32), dtype=np.int64)] = unpacked(r[column])
    return out


def numbers_of(replies: list[dict], n: int) -> np.ndarray:
    """The number of every word of a block: its bin, and its place there."""
    out = np.zeros(n, U)
    for r in replies:
        out[np.cumsum(unpack(r["lids"], np.uint32), dtype=np.int64)] = unpack_ids(r["places"]) + (U(r["bin"]) << U(32))
    return out


# --- Pairs -------------------------------------------------------------------


class Pairs:
    """The distinct (context, word) pairs of a block by bin, context and word, and the pair at every token.

    Bins below ``wide`` hold whole contexts, those from it on parts of the contexts that are dealt over bins.
    """

    def __init__(self, row: dict, replies: list[dict], wide: int, limit: int):
        self.n = n = row["n"]
        self.counts = gather(replies, "counts", n)
        self.word = word = numbers_of(replies, n)
        seq = unpack(row["positions"], np.uint32).astype(np.int64)
        before = np.concatenate(([0], seq[:-1]))  # every text ends with word 0, so each begins after it
        self.parts = 1 + self.counts // limit  # of every word as a context
        home = ((mix(word) >> U(32)) * U(wide) >> U(32)).astype(np.int64)
        words, contexts = np.argsort(word), np.lexsort((word, home))
        by_word, by_context = np.empty(n, np.int64), np.empty(n, np.int64)
        by_word[words], by_context[contexts] = np.arange(n), np.arange(n)
        code, inverse = np.unique(by_context[before] * n + by_word[seq], return_inverse=True)
        v, w = contexts[code // n], words[code % n]
        at = home[v]
        hot = self.parts[v] > 1
        if hot.any():
            at[hot] = wide + (home[v[hot]] + (mix(word[w[hot]] ^ U(0x5851F42D4C957F2D)) % self.parts[v[hot]].astype(U)).astype(np.int64)) % wide
            split = np.flatnonzero(hot)
            order = np.concatenate((np.flatnonzero(~hot), split[np.lexsort((word[w[split]], word[v[split]], at[split]))]))
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            v, w, at, inverse = v[order], w[order], at[order], place[inverse]
        self.v, self.w, self.at, self.token, self.seq = v, w, at, inverse, seq
        self.lengths = np.asarray(row["lengths"], np.int64)
        learn = np.repeat(np.asarray(row["train"], bool), self.lengths)
        self.train = np.bincount(inverse[learn], minlength=len(v))

    def starts(self, own: slice) -> np.ndarray:
        """Where a new context begins among the pairs of a bin."""
        v = self.v[own]
        return np.concatenate(([True], v[1:] != v[:-1]))


_SENT = "block bigint, at int, contexts binary, sizes binary, words binary, train binary"


def _send_pairs(wide: int, limit: int):
    """Every bin of contexts gets a block's pairs and their training counts."""

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        for row in block.to_pylist():
            p = Pairs(row, replies.to_pylist(), wide, limit)
            for at, own in runs(p.at):
                new = p.starts(own)
                sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
                rows.append((row["block"], at, pack_ids(p.word[p.v[own][new]]), pack_numbers(sizes), pack_ids(p.word[p.w[own]]), pack_numbers(p.train[own])))
        return table_of(_SENT, rows)

    return run


#: What a bin of contexts keeps: its dishes (by restaurant, then word), and for every block the places of its pairs among them.
_KEPT = "at int, home bigint, contexts binary, sizes binary, words binary, dish binary, train binary, places binary"


def _merge(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    contexts = [unpack_ids(r["contexts"]) for r in rows]
    sizes = [unpack_numbers(r["sizes"]) for r in rows]
    words, dish = np.unique(np.concatenate([unpack_ids(r["words"]) for r in rows]), return_inverse=True)
    every, number = np.unique(np.concatenate(contexts), return_inverse=True)
    code = np.repeat(number, np.concatenate(sizes)) * len(words) + dish
    code, inverse = np.unique(code, return_inverse=True)
    c = np.bincount(inverse, np.concatenate([unpack_numbers(r["train"]) for r in rows]), len(code)).astype(np.int64)
    own = np.bincount(code // len(words), minlength=len(every))
    out = [(rows[0]["at"], None, pack_ids(every), pack_numbers(own), pack_ids(words), pack_ids(code % len(words)), pack_numbers(c), None)]
    at = 0
    for r, n in zip(rows, sizes, strict=True):
        m = int(n.sum())
        out.append((r["at"], r["block"], None, None, None, None, None, pack_ids(inverse[at : at + m])))
        at += m
    return table_of(_KEPT, out)


class Restaurants:
    """The restaurants, or parts of them, of a bin."""

    def __init__(self, row: dict):
        self.at = row["at"]
        self.contexts, sizes = unpack_ids(row["contexts"]), unpack_numbers(row["sizes"])
        self.number = np.repeat(np.arange(len(sizes)), sizes)
        self.words, self.dish = unpack_ids(row["words"]), unpack_ids(row["dish"]).astype(np.int64)
        self.c = unpack_numbers(row["train"])

    def total(self, t: np.ndarray, known: dict[int, int] | None) -> np.ndarray:
        """The tables (or customers) of every restaurant; ``known`` has those of restaurants of which only parts are here."""
        if known is not None:
            return np.array([known.get(x, 0) for x in self.contexts.tolist()], float)
        return np.bincount(self.number, t, len(self.contexts))


#: After a sweep: the tables of a bin's dishes (kind t); for a bin of words the tables of its words (m); the tables of a part of a context (h).
_STATE = "kind string, at int, bin int, t binary, places binary, n binary, name bigint, tables bigint"


def _seat(k: int, wide: int, parent: Parent | None, hot: dict[int, int], seed: int):
    """Sweep ``k`` of a bin; without a parent, the first state, in which each dish has one table."""

    def run(kept: pa.Table, state: pa.Table) -> pa.Table:
        rooms = Restaurants(kept.to_pylist()[0])
        if parent is None:
            t = np.minimum(rooms.c, 1)
        else:
            rows = state.to_pylist()
            before = unpack_numbers(next(r["t"] for r in rows if r["kind"] == "t"))
            n = np.zeros(len(rooms.words), np.int64)
            answers = {r["bin"]: r["n"] for r in rows if r["kind"] == "a"}
            for where, own in runs(rooms.words >> U(32)):
                if where in answers:  # others have no table of these words
                    learned = np.flatnonzero(np.bincount(rooms.dish, before, len(rooms.words))[own] > 0) + own.start
                    n[learned] = unpack_numbers(answers[where])
            tables = rooms.total(before, hot if rooms.at >= wide else None)
            t = sweep(rooms.c, rooms.number, tables, parent(n)[rooms.dish], np.random.default_rng([seed, rooms.at, k]))
        out = [("t", rooms.at, None, pack_numbers(t), None, None, None, None)]
        sums = np.bincount(rooms.dish, t, len(rooms.words)).astype(np.int64)
        learned = np.flatnonzero(sums)
        words = rooms.words[learned]
        for where, own in runs(words >> U(32)):
            out.append(("m", rooms.at, where, None, pack_ids(words[own] & LOW), pack_numbers(sums[learned[own]]), None, None))
        if rooms.at >= wide:
            whole = rooms.total(t, None).astype(np.int64)
            out += [("h", rooms.at, None, None, None, None, int(x), int(y)) for x, y in zip(rooms.contexts.view(np.int64).tolist(), whole.tolist(), strict=True)]
        return table_of(_STATE, out)

    return run


_PARENT = "kind string, at int, bin int, n binary, customers bigint, once bigint, twice bigint"


def _seat_parent(table: pa.Table) -> pa.Table:
    """The parent's customers: of all words of a bin (kind p), and of the words that each bin of contexts has sent (a)."""
    rows = [(r["at"], unpack_ids(r["places"]).astype(np.int64), unpack_numbers(r["n"])) for r in table.to_pylist()]
    total = np.zeros(max(int(p[-1]) for _, p, _ in rows) + 1, np.int64)
    for _, places, n in rows:
        total[places] += n
    where = table.column("bin")[0].as_py()
    out = [("p", None, where, pack_numbers(total), int(total.sum()), int((total == 1).sum()), int((total == 2).sum()))]
    out += [("a", at, where, pack_numbers(total[places]), None, None, None) for at, places, _ in rows]
    return table_of(_PARENT, out)


# --- Answers to blocks -------------------------------------------------------

#: What a block gets at last: words' numbers and counts (w), words' customers at the parent in every sample (p), pairs' counts and tables (c).
_REPLY = "home bigint, kind string, bin int, lids binary, places binary, counts binary, at int, tables binary, totals binary"


def _answer_words(samples: int):
    """For every block the parent's customers of its words in every sample."""

    def run(asked: pa.Table, parents: pa.Table) -> pa.Table:
        rows = [(r, unpack_ids(r["places"]).astype(np.int64)) for r in asked.to_pylist() if r["home"] is not None]
        total = np.zeros((samples, 1 + max((int(p.max()) for _, p in rows), default=0)), np.int64)  # words that no training row has stay at 0
        for i, r in enumerate(sorted(parents.to_pylist(), key=lambda r: r["sample"])):
            n = unpack_numbers(r["n"])
            total[i, : len(n)] = n
        return table_of(_REPLY, [(r["home"], "p", r["bin"], r["lids"], None, None, None, pack_numbers(total[:, places].ravel()), None) for r, places in rows])

    return run


def _answer_pairs(wide: int):
    """For every block its pairs' customers and tables over all samples, and those of their restaurants in every sample."""

    def run(kept: pa.Table, states: pa.Table) -> pa.Table:
        rows = kept.to_pylist()
        rooms = Restaurants(next(r for r in rows if r["home"] is None))
        t = [unpack_numbers(r["t"]) for r in sorted(states.to_pylist(), key=lambda r: r["sample"])]
        tables = sum(t)
        totals = None if rooms.at >= wide else np.stack([rooms.total(x, None) for x in (rooms.c, *t)]).astype(np.int64)
        out = []
        for r in rows:
            if r["home"] is not None:
                own = unpack_ids(r["places"]).astype(np.int64)
                number = rooms.number[own]
                first = np.concatenate(([True], number[1:] != number[:-1]))
                out.append((r["home"], "c", None, None, None, pack_numbers(rooms.c[own]), rooms.at, pack_numbers(tables[own]), None if totals is None else pack_numbers(totals[:, number[first]].ravel())))
        return table_of(_REPLY, out)

    return run


def _sum_up(wide: int, limit: int, tokens: int, types: int, parents: list[Parent], hot: list[dict[int, int]]):
    """The scores of a block's texts."""

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        got: dict[str, list[dict]] = {"w": [], "p": [], "c": []}
        for r in replies.to_pylist():
            got[r["kind"]].append(r)
        p = Pairs(row, got["w"], wide, limit)
        samples = len(parents)
        own = np.zeros((samples, p.n), np.int64)  # the parent's customers of the block's words
        for r in got["p"]:
            own[:, np.cumsum(unpack(r["lids"], np.uint32), dtype=np.int64)] = unpack_numbers(r["tables"]).reshape(samples, -1)
        c, t, customers = np.zeros(len(p.v)), np.zeros(len(p.v)), p.counts[p.v].astype(float)  # a word is followed as often as it occurs
        tables = np.zeros((samples, len(p.v)))
        spans = dict(runs(p.at))
        for r in got["c"]:
            at = spans[r["at"]]
            c[at], t[at] = unpack_numbers(r["counts"]), unpack_numbers(r["tables"]) / samples
            if r["totals"] is not None:
                number = np.cumsum(p.starts(at)) - 1
                totals = unpack_numbers(r["totals"]).reshape(samples + 1, -1)
                tables[:, at] = totals[1:][:, number]
        split = np.flatnonzero(p.parts > 1)
        if len(split):
            whole = np.zeros((samples, p.n))
            whole[:, split] = [[known.get(x, 0) for x in p.word[split].tolist()] for known in hot]
            own_parts = p.at >= wide
            tables[:, own_parts] = whole[:, p.v[own_parts]]
        base = sum((STRENGTH + DISCOUNT * tables[i]) * parents[i](own[i])[p.w] for i in range(samples)) / samples
        score = np.log10((c - DISCOUNT * t + base) / (STRENGTH + customers))[p.token]
        flat = np.log10((p.counts + 0.5) / (tokens + 0.5 * (types + 1)))
        starts = np.concatenate(([0], np.cumsum(p.lengths)[:-1]))
        keys = block.column("keys").combine_chunks().flatten()
        return pa.table(
            [
                keys, pa.array([not x for x in row["train"]]), pa.array(p.lengths, pa.int64()), pa.array(np.add.reduceat((p.counts > 0)[p.seq].astype(np.int64), starts)),
                pa.array([tokens] * len(keys), pa.int64()), pa.array(np.add.reduceat(flat[p.seq], starts)), pa.array(np.add.reduceat(score, starts)),
            ],
            ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def _null(*columns: str) -> list:
    return [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 5, remainder: int = 1, words_per_bin: int = WORDS_PER_BIN, pairs_per_bin: int = PAIRS_PER_BIN, least_hot: int = LEAST_HOT, seed: int = SEED, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), (~held_out(key, modulus, remainder)).alias("train"), F.col(text).cast("binary").alias("text"))
    schema = f"block bigint, keys array<{kind}>, train array<boolean>, lengths array<int>, positions binary, words array<binary>, counts binary, n bigint, tokens bigint"
    blocks = spark.table(bucketed(map_arrow(rows, _tokenise, schema), "block"))
    n_words, n_tokens = blocks.agg(F.sum("n"), F.sum("tokens")).first()
    bins = max(12, -(-int(n_words or 0) // words_per_bin))
    dealt = map_arrow(blocks.select("block", "words", "counts"), _deal(bins), _DEALT)
    words = spark.table(bucketed(dealt.groupBy("bin").applyInArrow(grouped(_vocabulary), _VOCABULARY), "bin"))
    types, tokens = (int(x or 0) for x in words.agg(F.sum("types"), F.sum("tokens")).first())
    asked = words.where("home is not null").select("home", F.lit("w").alias("kind"), "bin", "lids", "places", "counts", *_null("at int", "tables binary", "totals binary"))
    wide = max(12, -(-int(n_tokens or 0) // pairs_per_bin))
    limit = max(least_hot, tokens // HOT_SHARE)
    texts = blocks.select("block", "keys", "train", "lengths", "positions", "n").groupBy("block")
    sent = texts.cogroup(asked.groupBy("home")).applyInArrow(grouped(_send_pairs(wide, limit)), _SENT)
    kept = spark.table(bucketed(sent.groupBy("at").applyInArrow(grouped(_merge), _KEPT), "at"))
    dishes = kept.where("home is null").drop("home", "places").groupBy("at")
    # Sweeps: contexts and parent in turn.  State 0 is the first, states after burn_in sweeps are samples.
    states, answers, parents, hots = [], [], [], []
    discount = DISCOUNT
    for k in range(burn_in + samples + 1):
        if k:
            had = states[-1].where("kind = 't'").select("kind", "at", "bin", "t", F.lit(None).cast("binary").alias("n")).unionByName(answers[-1].where("kind = 'a'").select("kind", "at", "bin", F.lit(None).cast("binary").alias("t"), "n"))
            seating = _seat(k, wide, parents[-1], hots[-1], seed)
        else:
            had = spark.createDataFrame([], "kind string, at int, bin int, t binary, n binary")
            seating = _seat(k, wide, None, {}, seed)
        state = materialise(dishes.cogroup(had.groupBy("at")).applyInArrow(grouped(seating), _STATE), "state")
        seen = Observation()
        parent = state.where("kind = 'm'").select("at", "bin", "places", "n").groupBy("bin").applyInArrow(grouped(_seat_parent), _PARENT)
        parent = materialise(parent.observe(seen, *(F.sum(c).alias(c) for c in ("customers", "once", "twice"))), "parent")
        customers, once, twice = (int(seen.get.get(c) or 0) for c in ("customers", "once", "twice"))
        if not k and once + twice:
            discount = min(0.95, max(0.05, once / (once + 2 * twice)))
        states.append(state)
        answers.append(parent)
        parents.append(Parent(customers, types, discount))
        hots.append({r["name"] & (2**64 - 1): r["tables"] for r in state.where("kind = 'h'").groupBy("name").agg(F.sum("tables").alias("tables")).collect()})  # at most HOT_SHARE
    chosen = range(burn_in + 1, burn_in + samples + 1)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    sampled = union([states[k].where("kind = 't'").select("at", "t", F.lit(k).alias("sample")) for k in chosen])
    pairs = kept.groupBy("at").cogroup(sampled.groupBy("at")).applyInArrow(grouped(_answer_pairs(wide)), _REPLY)
    seated = union([answers[k].where("kind = 'p'").select("bin", "n", F.lit(k).alias("sample")) for k in chosen])
    known = words.select("bin", "home", "lids", "places").groupBy("bin").cogroup(seated.groupBy("bin")).applyInArrow(grouped(_answer_words(samples)), _REPLY)
    replies = asked.unionByName(pairs).unionByName(known)
    out = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    summed = _sum_up(wide, limit, tokens, types, [parents[k] for k in chosen], [hots[k] for k in chosen])
    return texts.cogroup(replies.groupBy("home")).applyInArrow(grouped(summed), out).withColumnRenamed("key", key)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of held-out and training rows: 10 ** -(mean log10 probability of a token)."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.sum("n_tokens").alias("n_tokens"))
