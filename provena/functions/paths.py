"""Path and file-name functions: globs, sanitising, slugs, collision keys."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extension of every known image format, and formats by extension.
FORMAT_EXTENSIONS = {"jpeg": ".jpg", "png": ".png", "webp": ".webp", "avif": ".avif", "gif": ".gif"}
EXTENSION_FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "avif": "avif", "gif": "gif"}


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob with ``**``, ``*``, ``?``, ``[...]`` and ``{a,b}``; dots are ordinary."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "(?:/.*)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]", end
        elif c == "{" and "}" in pattern[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | posix(path).rlike(glob_to_regex(p))
    return out


def preference_score(path: Column, preferences: Sequence[tuple[str, float]]) -> Column:
    """Sum of the weights of all matching globs; 0 without a match."""
    out = F.lit(0.0)
    for pattern, weight in preferences:
        out = out + F.when(posix(path).rlike(glob_to_regex(pattern)), F.lit(float(weight))).otherwise(F.lit(0.0))
    return out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension_for(path: Column, fmt: Column) -> Column:
    known = F.coalesce(*[F.when(fmt == k, F.lit(v)) for k, v in FORMAT_EXTENSIONS.items()], F.concat(F.lit("."), fmt))
    return F.when(extension(path) != "", extension(path)).otherwise(known)


def sanitise(component: Column) -> Column:
    """Unsafe and control characters to ``-``, runs of white space to one space, no dots or spaces at the ends."""
    out = F.regexp_replace(component, r'[\x00-\x1f<>:"/\\|?*]', "-")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r"^[. ]+|[. ]+$", "")
    return F.when(out == "", "untitled").otherwise(out)


def slug_of(text: str | None) -> str | None:
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))
    return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-") or "image"


def collision_key_of(path: str | None) -> str | None:
    return None if path is None else unicodedata.normalize("NFC", path.replace("\\", "/")).lower()


@F.pandas_udf(T.StringType())
def _slug_udf(names: pd.Series) -> pd.Series:
    return names.map(slug_of)


@F.pandas_udf(T.StringType())
def _key_udf(paths: pd.Series) -> pd.Series:
    return paths.map(collision_key_of)


def plain_slug(component: Column) -> Column:
    """Slug of an ASCII name, by expressions."""
    out = F.regexp_replace(F.regexp_replace(F.lower(component), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(out == "", "image").otherwise(out)


def slugify(component: Column) -> Column:
    """Slug of any name, by Unicode normalisation in an Arrow UDF; ``by_plainness`` keeps ASCII names away from it."""
    return _slug_udf(component)


def plain_key(path: Column) -> Column:
    return F.lower(posix(path))


def collision_key(path: Column) -> Column:
    """What two paths share that one file system folder cannot hold both, in an Arrow UDF."""
    return _key_udf(path)


def by_plainness(df: DataFrame, test: Column, name: str, plain: Column, other: Column) -> DataFrame:
    """``df`` with a column that is ``plain`` where ``test`` is ASCII (or null) and ``other`` elsewhere.

    Two branches, because Spark evaluates a Python UDF for all rows of the plan
    that it is in, also below a CASE.
    """
    ascii_only = F.coalesce(test.rlike(r"^[\x00-\x7f]*$"), F.lit(True))
    return df.where(ascii_only).withColumn(name, plain).unionByName(df.where(~ascii_only).withColumn(name, other))


def with_collision_key(df: DataFrame, path: str, name: str) -> DataFrame:
    return by_plainness(df, F.col(path), name, plain_key(F.col(path)), collision_key(F.col(path)))


def append_suffix(path: Column, suffix: Column) -> Column:
    """``dir/name.ext`` becomes ``dir/name-suffix.ext``; a leading dot is no extension."""
    has_dot = path.rlike(r"[^/]\.[^./]*$")
    head, tail = F.regexp_extract(path, r"^(.*[^/])(\.[^./]*)$", 1), F.regexp_extract(path, r"^(.*[^/])(\.[^./]*)$", 2)
    return F.when(has_dot, F.concat(head, F.lit("-"), suffix, tail)).otherwise(F.concat(path, F.lit("-"), suffix))
