"""Toxicity scores of texts restored by a noisy-channel decoder.

Suspicious tokens (letters mixed with look-alike signs, letters three times in
a row, single letters spaced out) become character lattices: every sign may
stand for itself or for letters, a repeated letter may be dropped, a separator
between single letters may be dropped.  Viterbi search finds the likeliest
letters under a character trigram model of the training texts.  Words of the
restored text, with their prefixes, are the features of a logistic model.

Edge cases: null and empty texts are scored by the intercept; with labels of
one class only (or none) scores are the smoothed share of ones; repeated rows
and null keys are scored row by row; further columns are ignored.  The whole
text is read, and the work is linear in its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, mapped_column, materialise
from .labelled import SCALE, Rows, minimise, sigmoid, training_rows, whole
from .words import chunks

THRESHOLD = 0.3
MAX_FEATURES = 4096
MIN_ROWS = 3
MIN_EVIDENCE = 20.0
CACHE = 150_000
SHRINK = 1e-5

# The letters of the character model ("#" ends a word, "?" is any other letter).
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûüœ"
# Signs and the letters they may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "*": "aeiou", "#": "h", "%": "x",
}
SEPARATORS = " .-_*~,/"
_SIGN = "".join(re.escape(c) for c in SIGNS)
_SIGNS = "".join(SIGNS)
_SPACED = re.compile(rf"(?<![^\W\d_])(?:[^\W\d_]|[{_SIGN}])(?:[ ._\-*~,/](?:[^\W\d_]|[{_SIGN}])){{3,}}(?![^\W\d_])")
_SOUP = re.compile(rf"(?:[^\W\d_]|[{_SIGN}])+")
_TRIPLE = re.compile(r"(.)\1\1")
_RUN = re.compile("1{4,}")
WORD = re.compile(r"[^\W\d_]+")
#: Signs that stand for no letter: around a token's letters they change nothing.
_MARKS = ".,;:?\"'`)-[]{}>/=&~^"
_SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
N_SYMBOLS = len(LETTERS) + 2
OTHER = N_SYMBOLS - 1

#: Costs of the channel: a sign for a letter, a sign kept, a dropped repeat (of three or more; of two), a kept repeat, a dropped separator, a kept separator.
COST = {"sign": 1.0, "keep": 7.0, "drop": 0.7, "double": 3.0, "repeat": 0.7, "join": 0.1, "split": 3.0}


def symbol(c: str) -> int:
    return _SYMBOL.get(c, OTHER)


class CharModel:
    """Interpolated trigram model over N_SYMBOLS symbols: its tables have a fixed size."""

    def __init__(self, counts: np.ndarray):
        three = counts.astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 0.5) / (one + 0.5).sum()
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
        self.cost = -np.log(p3)


def trigram_counts(words: Counter) -> np.ndarray:
    out = np.zeros((N_SYMBOLS,) * 3, np.int64)
    for w, n in words.items():
        a = b = 0
        for c in [*map(symbol, w), 0]:
            out[a, b, c] += n
            a, b = b, c
    return out


def text_trigrams(texts: list[str]) -> np.ndarray:
    """``trigram_counts`` of the lower-cased words of all texts, without a loop over words."""
    codes = np.frombuffer("\n".join([*map(str.lower, texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.flatnonzero(np.bincount(codes, minlength=1))
    table = np.zeros(int(used.max(initial=0)) + 1, np.int32)
    table[used] = [symbol(c) if WORD.match(c) else 0 for c in map(chr, used)]
    # Every symbol with the two before it: 0 before a word's start, and once behind its end.
    c = np.concatenate(([0, 0], table[codes]))
    a, b, c = c[:-2], c[1:-1], c[2:]
    at = ((np.where(b == 0, 0, a) * N_SYMBOLS + b) * N_SYMBOLS + c)[(b != 0) | (c != 0)]
    return np.bincount(at, minlength=N_SYMBOLS**3).reshape((N_SYMBOLS,) * 3)


def _spell(text: tuple | None) -> str:
    out = []
    while text:
        text, added = text
        out.append(added)
    return "".join(reversed(out))


def decode(raw: str, model: CharModel) -> str:
    """The likeliest letters behind a suspicious span; words are joined by spaces."""
    cost = model.cost
    # A state is the last two symbols; its value is (cost, text), a text being None or (text before, what was added).
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for i, c in enumerate(raw):
        options: list[tuple[str, float]] = []
        drop = COST["drop"] if c * 3 in raw[max(0, i - 2) : i + 3] else COST["double"]
        if c in SEPARATORS and 0 < i < len(raw) - 1 and (c not in SIGNS or raw[i - 1].isalpha() or raw[i - 1] in SIGNS):
            options = [("", COST["join"]), (" ", COST["split"])]
            if c in SIGNS:
                options += [(x, COST["sign"]) for x in SIGNS[c]]
        elif c in SIGNS:
            options = [(x, COST["sign"]) for x in SIGNS[c]] + [(" ", COST["keep"])]
            if before == c:
                options.append(("", drop))
        elif c == before:
            options = [("", drop), (c, COST["repeat"])]
        else:
            options = [(c, 0.0)]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (held, text) in states.items():
            for emit, extra in options:
                if not emit:
                    at, total = (a, b), held + extra
                elif emit == " ":
                    at, total = (0, 0), held + extra + (cost[a, b, 0] if text and text[1] != " " else 0.0)
                else:
                    s = symbol(emit)
                    at, total = (b, s), held + extra + cost[a, b, s]
                if at not in new or total < new[at][0]:
                    new[at] = (total, (text, emit) if emit else text)
        states = new
        before = c
    least = min(held + cost[a, b, 0] for (a, b), (held, _) in states.items())
    return min(_spell(text) for (a, b), (held, text) in states.items() if held + cost[a, b, 0] == least).strip()


class Restorer:
    """Restores texts; remembers decoded spans and the words of tokens with other signs, up to CACHE of either."""

    def __init__(self, model: CharModel):
        self.model, self.known, self.split = model, {}, {}

    def span(self, raw: str) -> str:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > CACHE:
                self.known.clear()
            found = self.known[raw] = decode(raw, self.model)
        return found

    def _soup(self, m: re.Match) -> str:
        """Letters with look-alike signs before, between or behind them; other signs around them stay."""
        run = m[0]
        core = run.strip(_SIGNS)
        if not core or len(core) == len(run) and core.isalpha():
            return run
        lead, tail = len(run) - len(run.lstrip(_SIGNS)), len(run) - len(run.rstrip(_SIGNS))
        start = lead if lead > 3 else 0
        inside = not core.isalpha() or 0 < lead <= 3
        kept = tail <= 2 and (inside or all(c in "0123456789@$" for c in run[len(run) - tail :]))
        if not inside and not kept:
            return run
        end = len(run) if kept else len(run) - tail
        return run[:start] + self.span(run[start:end]) + run[end:]

    def _repeats(self, m: re.Match) -> str:
        return self.span(m[0]) if _TRIPLE.search(m[0]) else m[0]

    def token(self, token: str) -> str:
        """A token (no white space inside) with its suspicious parts decoded."""
        if token.isalpha():
            return self.span(token) if _TRIPLE.search(token) else token
        token = _SPACED.sub(lambda m: self.span(m[0]), token)
        return WORD.sub(self._repeats, _SOUP.sub(self._soup, token))

    def words(self, token: str) -> tuple[str, ...]:
        """The words of a restored token."""
        core = token.strip(_MARKS)
        if core.isalpha():
            return tuple(WORD.findall(self.span(core))) if _TRIPLE.search(core) else (core,)
        if core.isdecimal():
            return ()
        found = self.split.get(token)
        if found is None:
            if len(self.split) > CACHE:
                self.split.clear()
            found = self.split[token] = tuple(WORD.findall(self.token(token)))
        return found

    def tokens(self, text: str) -> tuple[list[str], list[str]]:
        """The lower-cased tokens of a text, and what its runs of single characters spell."""
        words = text.lower().split()
        alone = "".join(["1" if len(w) == 1 else "0" for w in words])
        return words, [self.span(" ".join(words[m.start() : m.end()])) for m in _RUN.finditer(alone)]

    def __call__(self, text: str) -> str:
        """The restored text, its tokens joined by single spaces."""
        words = text.lower().split()
        alone = "".join(["1" if len(w) == 1 else "0" for w in words])
        out, at = [], 0
        for m in _RUN.finditer(alone):
            out += map(self.token, words[at : m.start()])
            out.append(self.span(" ".join(words[m.start() : m.end()])))
            at = m.end()
        return " ".join([*out, *map(self.token, words[at:])])


def names(word: str) -> list[str]:
    """Features of a word: itself and its prefixes."""
    if len(word) >= 8:
        return ["=" + word, word[:4] + "-", word[:5] + "-", word[:6] + "-", word[:7] + "-", word[:8] + "-"]
    return ["=" + word, *[word[:n] + "-" for n in range(4, len(word) + 1)]]


class Model:
    """The character model and at most MAX_FEATURES weights."""

    def __init__(self, chars: CharModel, index: dict[str, int], weights: np.ndarray, bias: float):
        self.chars, self.index, self.weights, self.bias = chars, index, weights, bias


class Finder:
    """Feature numbers and values of texts under a model's index; remembers words, up to CACHE of them.

    A feature's value grows with its share of the words, so that one chance
    hit in a long text weighs little.
    """

    def __init__(self, chars: CharModel, index: dict[str, int]):
        self.restore, self.index = Restorer(chars), index
        # Words that were looked up, and the numbers of those that have any.
        self.known: set[str] = set()
        self.hits: dict[str, tuple[int, ...]] = {}
        #: No other word has a feature in the index than one with such first letters.
        self.starts = {f[1:5] if f[0] == "=" else f[:4] for f in index}

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        if not text:
            return [], []
        known, hits, out, index, starts = self.known, self.hits, Counter(), self.index, self.starts
        tokens, spelled = self.restore.tokens(text)
        words = Counter(tokens)
        words.update(w for run in spelled for w in run.split())
        distinct = set(words)
        if len(known) > CACHE:
            known.clear()
            hits.clear()
        for w in distinct.difference(known):
            ids = {index[f] for x in self.restore.words(w) if x[:4] in starts for f in names(x) if f in index}
            if ids:
                hits[w] = tuple(ids)
        known |= distinct
        for w in filter(hits.__contains__, distinct):
            n = words[w]
            for i in hits[w]:
                out[i] += n
        scale = 200.0 / (words.total() + 20)
        at = sorted(out)
        return at, [math.log1p(scale * out[i]) for i in at]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, key: str = "doc_id", text: str = "text", local_rows: int | None = None) -> Model:
    """Learns from every labelled row outside the held-out fold."""
    rows = materialise(training_rows(docs, labels, label, modulus, remainder, key, text), "training")
    spark = docs.sparkSession

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_SYMBOLS,) * 3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in chunks(texts):
                total += text_trigrams(texts[i:j])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    counted = map_arrow(rows.select("text"), trigrams, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most N_SYMBOLS**3 rows
    table = np.zeros(N_SYMBOLS**3, np.int64)
    table[counted["at"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    chars = CharModel(table.reshape((N_SYMBOLS,) * 3))
    shared = spark.sparkContext.broadcast(chars)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            ones, zeros = Counter(), Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, spelled = restore.tokens(t)
                seen = set(chain.from_iterable(map(restore.words, set(tokens)))).union(*map(str.split, spelled))
                (ones if y else zeros).update(set(chain.from_iterable(map(names, seen))))
            every = list(ones.keys() | zeros.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c.get(f, 0) for f in every], pa.int64()) for c in (ones, zeros))], ["f", "one", "zero"])

    by = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in by}
    one, zero = n.get(1, 0), n.get(0, 0)
    seen = map_arrow(rows.select("text", "y"), presence, "f string, one bigint, zero bigint").groupBy("f").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).where(f"one + zero >= {MIN_ROWS}")
    # How surely a feature tells the classes apart: twice the log-likelihood ratio of its two counts.
    g = lambda k, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * F.lit(one + zero) / ((F.col("one") + F.col("zero")) * F.lit(max(1, n))))).otherwise(0.0)
    seen = seen.where(2 * (g("one", one) + g("zero", zero)) >= MIN_EVIDENCE)
    p, q = (F.col("one") + 0.5) / (one + 1.0), (F.col("zero") + 0.5) / (zero + 1.0)
    weight = F.abs(F.log(p / q)) * F.sqrt(F.abs(F.col("one") / F.lit(one + 1.0) - F.col("zero") / F.lit(zero + 1.0)))
    best = seen.select("f", weight.alias("w")).orderBy(F.desc("w"), "f").limit(MAX_FEATURES).toPandas()
    index = {f: i for i, f in enumerate(best["f"])}
    bias = math.log((one + 0.5) / (zero + 0.5)) if one + zero else math.log(0.1 / 0.9)
    model = Model(chars, index, np.zeros(len(index)), bias)
    if not one or not zero:
        discard(rows)
        return model
    own = spark.sparkContext.broadcast(index)

    held: dict[str, Finder] = {}

    def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        find = held.setdefault("find", Finder(shared.value, own.value))
        x = [find(t) for t in batch.column(0).to_pylist()]
        row = np.repeat(np.arange(len(x)), [len(a) for a, _ in x])
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
        return y, row.astype(np.int32), np.array([i for a, _ in x for i in a], np.int32), np.array([u for _, v in x for u in v], float)

    found = Rows.of(rows.select("text", "y"), vectors, "toxicity", local_rows)
    discard(rows)
    size = len(index)

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(y: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> np.ndarray:
            s = np.bincount(row, w[col] * value, len(y)) + w[-1]
            r = sigmoid(s) - y
            lost = whole(np.logaddexp(0, s) - s * y).sum()
            return np.concatenate([np.bincount(col, whole(r[row] * value), size), [whole(r).sum(), lost]]).astype(np.int64)

        out = found.sums(run, size + 2) / SCALE / (one + zero)
        g = out[:-1]
        g[:-1] += SHRINK * w[:-1]
        return float(out[-1] + SHRINK / 2 * (w[:-1] @ w[:-1])), g

    w = minimise(evaluate, np.append(np.zeros(size), bias))
    found.drop()
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        find = Finder(m.chars, m.index)
        for batch in batches:
            s = np.array([m.bias + float(np.dot(m.weights[a], v)) for a, v in map(find, batch.column(1).to_pylist())], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(s))], ["_key", "score"])

    return map_arrow(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), run, f"_key {kind}, score double").withColumnRenamed("_key", key)


def non_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; no row is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[str, Finder] = {}

    def scores(texts: list) -> pa.Array:
        m = shared.value
        find = held.setdefault("find", Finder(m.chars, m.index))
        return pa.array(sigmoid(np.array([m.bias + float(np.dot(m.weights[a], v)) for a, v in map(find, texts)], float)))

    scored = mapped_column(docs, text, "__score", "double", scores)
    return scored.where(F.col("__score") < threshold).select(*docs.columns)
