"""Secret scanning: base patterns and an assignment-aware lexer.

The base patterns find assignments with a sensitive keyword, access keys and
long hexadecimal runs.  The lexer reads source and configuration syntax into
name-literal pairs, propagates constants (``B = A`` gives B the literal of A,
through any number of assignments in the order of the text), and scores each
literal by how sensitive its target names are and by how random it looks.  It
knows ``name = "literal"``, ``name: literal``, ``"name": "literal"``,
``x["name"] = "literal"``, ``name => literal``, ``<name>literal</name>``,
``--name literal``, ``key="name" value="literal"`` and ``name: N`` above
``value: literal``; strings with prefixes and escapes; and strings put together
by ``+``, ``.`` or ``&``, or side by side in parentheses, over any number of
lines.  A literal in a comment counts (it is in the text all the same), but
defines no constant.

A span is ``(kind, start, end)`` in code points, end exclusive; base spans cover
the whole match, the lexer's ``literal`` spans the literal alone; one that is put
together has a span for each part, and they share its score.

Edge cases: null and empty texts have no spans; repeated rows and null keys
pass through row by row; further columns are ignored.  Literals have any length.
Work per text is linear in its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_SCORE = 0.6

#: What a target name may contain, with the weight it lends (fixed values of this scanner).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "privatekey": 1.0, "accesskey": 0.9, "authkey": 0.9, "bearer": 0.8, "signature": 0.5, "auth": 0.5, "key": 0.4,
}
PLACEHOLDERS = {"changeme", "example", "placeholder", "undefined", "required", "redacted", "password", "disabled"}

#: A name, an assignment sign, and the beginning of a quoted or bare value.
PAIR = re.compile(
    r"""(?a)(?P<flag>--?)?["']?(?P<name>[A-Za-z_$][\w$.-]{0,80})["']?\]?(?:\x20*(?:=>|:=|[:=])\x20*|(?P<gap>\x20+)|>)"""
    r"""(?P<open>\((?=[\s(]*[A-Za-z]{0,2}["']))?(?:(?P<quoted>\s{0,80}+(?:[rbfuRBFU@]{1,2}(?=["']))?+["'`])|(?P<bare>[A-Za-z0-9+/_.=$@!%*~^-]))"""
)
#: A whole string from its quote on; a backslash takes the sign after it along.
STRING = re.compile(r"""(?s)"((?:[^"\n\\]++|\\.)*+)"|'((?:[^'\n\\]++|\\.)*+)'|`((?:[^`\n\\]++|\\.)*+)`""")
#: What joins the next string to one: a sign, or in parentheses nothing at all.
JOINED = re.compile(r"""(?s)[ \t]*+(?:[+.&][ \t]*+(?:\\?\n[ \t]*+)?|\\?\n[ \t]*+[+.&][ \t]*+)(?:[rbfuRBFU]{1,2}(?=["']))?+(?=["'`])""")
JOINED_INSIDE = re.compile(r"""\s*+(?:[+.&]\s*+)?(?:[rbfuRBFU]{1,2}(?=["']))?+(?=["'`])""")
ESCAPE = re.compile(r"(?s)\\(.)")
#: A line up to its comment: strings, and signs that begin none.
CODE = re.compile(r"""(?:[^"'#/]++|"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|["']|(?<=\S)#|/(?!/)|(?<=[^\s])//)*+""")
#: Names and literals as attributes of one element, or as two entries of one mapping.
ATTRIBUTES = re.compile(r"""(?a)\b(?:key|name|id)=["'](?P<name>[\w$.:-]{1,80})["']\s{1,80}value=(?:"(?P<dq>[^"\n]*)"|'(?P<sq>[^'\n]*)')""")
ENTRIES = re.compile(r"""(?a)\b(?:key|name):\x20{0,9}["']?(?P<name>[\w.-]{1,80})["']?\x20{0,9}\n[\x20\t]{0,80}value:\x20{0,9}(?:"(?P<dq>[^"\n]*)"|'(?P<sq>[^'\n]*)'|(?P<bare>[^\s"'#]+))""")
#: A whole bare literal; PAIR has its first character only, as every name within one shares its end.
BARE = re.compile(r"[A-Za-z0-9+/_.=$@!%*~^-]+")
#: Names have at most so many characters.
NAME_CHARS = 81
HINT = re.compile(r"(?ai)pass|pwd|secret|token|key|credential|auth|bearer|signature")
SIGN = re.compile(r"[=:>]|--")


def entropy(counts: Counter) -> float:
    n = counts.total()
    return -math.fsum(c / n * math.log2(c / n) for c in counts.values() if c)


def name_weight(name: str) -> float:
    plain = re.sub(r"[^a-z]", "", name.lower())
    return max((w for k, w in SENSITIVE.items() if k in plain), default=0.0)


def literal_weight(literal: str) -> float:
    """0 to 1: how much a literal looks like a generated or chosen secret."""
    if len(literal) < 8 or re.search(r"\s", literal) or literal.lower() in PLACEHOLDERS or re.fullmatch(r"\$\{?\w+\}?|<.*>|\*+|x+|[\d.,:/-]+|true|false|null|none", literal, re.I):
        return 0.0
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 * classes + 0.12 * entropy(Counter(literal)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Suffixes:
    """Weights of ever shorter ends of one bare literal, as in ``a=b=c=...``, from counts of their characters."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.counts = Counter(text[start:end])

    def weight(self, start: int) -> float:
        """As literal_weight(), of an end that is longer than any name and has an assignment sign in it."""
        self.counts.subtract(self.text[self.start : start])
        self.start = start
        held = [c for c, n in self.counts.items() if n]
        classes = any("a" <= c <= "z" for c in held) + any("A" <= c <= "Z" for c in held) + any("0" <= c <= "9" for c in held) + any(not c.isalnum() for c in held)
        return min(1.0, 0.2 * classes + 0.12 * entropy(self.counts))


Spans = tuple[tuple[int, int], ...]


def strings(text: str, at: int, inside: bool) -> tuple[Spans, int]:
    """The parts of the string that begins at a quote, with what is joined to it, and where they end; none if it is not closed."""
    parts, end = [], at
    while m := STRING.match(text, at):
        parts.append(m.span(m.lastindex))
        end = m.end()
        more = (JOINED_INSIDE if inside else JOINED).match(text, end)
        if not more:
            break
        at = more.end()
    return tuple(parts), end


def pairs(text: str) -> Iterator[tuple[str, Spans, bool, bool]]:
    """(name, parts of the value, quoted, outside of comments) of every assignment, in order."""
    at = done = 0
    for line in text.split("\n"):
        stop = at + len(line)
        if stop > done and SIGN.search(line):
            code = at + CODE.match(line).end() if "#" in line or "//" in line else stop
            pos, run = max(at, done), 0
            while m := PAIR.search(text, pos, stop):
                pos = m.end("name") + 1  # a value may itself be the next name: a = b = "c"
                if m["gap"] and not m["flag"]:
                    continue  # words of prose beside each other
                if m["quoted"]:
                    parts, end = strings(text, m.end("quoted") - 1, m["open"] is not None)
                    if parts:
                        yield m["name"], parts, True, m.start() < code
                        pos = done = max(end, pos)
                else:
                    start = m.start("bare")
                    if m.end("bare") > run:
                        run = BARE.match(text, start, stop).end()
                    yield m["name"], ((start, run),), False, m.start() < code
        at = stop + 1
    for rule, sign in ((ATTRIBUTES, "value="), (ENTRIES, "value:")):
        if sign in text:
            for m in rule.finditer(text):
                yield m["name"], (m.span(m.lastgroup),), m.lastgroup != "bare", True


def content(text: str, parts: Spans) -> str:
    """The string that the parts make, without escapes."""
    return "".join(ESCAPE.sub(r"\1", text[a:b]) if "\\" in text[a:b] else text[a:b] for a, b in parts)


def lexed_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, str, float]]:
    """``(literal, start, end, name, score)`` of literals that reach a sensitive name."""
    if not HINT.search(text):
        return []
    constants: dict[str, Spans] = {}
    weights: dict[Spans, float] = {}
    best: dict[Spans, tuple[float, str]] = {}
    outer, ends = (0, 0), None  # the last bare literal that is not part of another
    for name, parts, quoted, defines in pairs(text):
        if not quoted:
            start, end = parts[0]
            if end - start <= NAME_CHARS:
                parts = constants.get(text[start:end], parts)
            elif end != outer[1]:
                outer, ends = parts[0], None
            elif text.find("=", start, end) >= 0:
                ends = ends or Suffixes(text, *outer)
                weights[parts] = ends.weight(start)
        if defines:
            constants[name] = parts
        if (weight := name_weight(name)) < min_score:
            continue  # no literal's weight is above 1
        if parts not in weights:
            weights[parts] = literal_weight(content(text, parts) if quoted else "".join(text[a:b] for a, b in parts))
        score = weight * weights[parts]
        if score > best.get(parts, (0.0, ""))[0]:
            best[parts] = (score, name)
    found = {(a, b): (name, score) for parts, (score, name) in best.items() if score >= min_score for a, b in parts if b > a}
    return [("literal", a, b, name, score) for (a, b), (name, score) in found.items()]


def scan_text(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str, float]]]:
    if not text:
        return [], []
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base_spans(text), key=lambda s: (s[1], order[s[0]])), sorted(lexed_spans(text), key=lambda s: (s[1], s[2]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key`` and ``found``: kind, start, end, name and score of every span, by start, then kind."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            found = []
            for x in batch.column(1).to_pylist():
                base, lexed = scan_text(x)
                rows = [{"kind": k, "start": a, "end": b, "name": None, "score": None} for k, a, b in base]
                rows += [{"kind": k, "start": a, "end": b, "name": n, "score": s} for k, a, b, n, s in lexed]
                found.append(sorted(rows, key=lambda r: (r["start"], order[r["kind"]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["_key", "found"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return map_arrow(rows, run, f"_key {kind}, found array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>").withColumnRenamed("_key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "literal")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
        count("literal").alias("n_literal"),
    )

