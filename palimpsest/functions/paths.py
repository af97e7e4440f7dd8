"""Paths of a tree: components separated by slashes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def clean(path: Column) -> Column:
    """Without empty and dot components, keeping a leading slash."""
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(parts(path), "/"))


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def depth(path: Column) -> Column:
    return F.size(parts(path))


def lineage(path: Column) -> Column:
    """The path and all paths above it, shortest first, without the root."""
    p, lead = parts(path), F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.transform(F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p))).otherwise(F.array().cast("array<int>")), lambda n: F.concat(lead, F.array_join(F.slice(p, F.lit(1), n), "/")))


def is_below(path: Column, root: Column) -> Column:
    """Whether path is root or lies under it, component by component."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/"))) | (root == "/") & F.startswith(path, root)


def glob_regex(glob: str) -> str:
    """A regular expression for a glob in the manner of ignore files.

    * and ? stay within a component, ** crosses them, [...] and {a,b} choose. A glob without a slash before its end matches
    at any depth; one that ends in a slash means what lies below.
    """
    rooted = "/" in glob.rstrip("/")
    body, out, i, open_ = glob.lstrip("/"), "", 0, 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            inner = body[i + 1 : j]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", j + 1
        elif c == "{":
            out, i, open_ = out + "(?:", i + 1, open_ + 1
        elif c == "}" and open_:
            out, i, open_ = out + ")", i + 1, open_ - 1
        elif c == "," and open_:
            out, i = out + "|", i + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^/?{'' if rooted else '(?:.*/)?'}{out}{'.+' if body.endswith('/') else ''}$"


def excluded(path: Column, globs: list[str], ignore_case: bool = False) -> Column:
    """Whether ordered globs leave a path out. The last that matches decides: with a leading ! it takes out, else in. If none matches and
    any glob takes in, the path is out."""
    flag = "(?i)" if ignore_case else ""
    hits = F.lit(None).cast("boolean")
    for g in globs:
        bare = g[1:] if g.startswith("!") else g
        hits = F.when(F.rlike(path, F.lit(flag + glob_regex(bare))), F.lit(g.startswith("!"))).otherwise(hits)
    return F.coalesce(hits, F.lit(any(not g.startswith("!") for g in globs)))


# How control characters and the escaping signs are written in stored names.
ESCAPES = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", "\\": "\\\\", '"': '\\"'}


def escape_name(raw: bytes) -> str:
    """Bytes of a file name as stored text: valid UTF-8 as it is but for ESCAPES, other bytes as \\xNN."""
    out, rest = [], raw
    while rest:
        try:
            text, rest = rest.decode(), b""
        except UnicodeDecodeError as e:
            text, bad, rest = rest[: e.start].decode(), rest[e.start : e.end], rest[e.end :]
        else:
            bad = b""
        out += [ESCAPES.get(c, c) for c in text] + [f"\\x{b:02x}" for b in bad]
    return "".join(out)


def unescape_name(stored: str) -> bytes:
    """The bytes of a stored name; also knows \\uNNNN and \\UNNNNNNNN."""
    back = {v[1]: k for k, v in ESCAPES.items()}

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] == "x":
            return chr(0xDC00 + int(x[1:], 16)) if int(x[1:], 16) > 127 else chr(int(x[1:], 16))
        return chr(int(x[1:], 16)) if x[0] in "uU" else back[x]

    return re.sub(r'\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[abfnrtv\\"])', one, stored).encode("utf-8", "surrogateescape")


def escaped(raw: Column) -> Column:
    """escape_name of a binary column, by Arrow batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else escape_name(bytes(b)))

    return run(raw)


def unescaped(stored: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unescape_name(t))

    return run(stored)
