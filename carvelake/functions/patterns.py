"""Verbose regular expressions as Java ones, and boolean columns over them."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLAGS = re.compile(r"\s*\(\?([a-z]+)\)")


@lru_cache(maxsize=None)
def flattened(pattern: str, unicode: bool = True) -> str:
    """A Java pattern that finds what ``pattern`` finds in Python.

    White space and comments of verbose patterns go, here and not by Java's own flag, which would strip them inside
    character classes too; brackets inside classes are escaped, since Java would nest them.
    """
    m = _FLAGS.match(pattern)
    flags = m[1] if m else ""
    rest = pattern[m.end() :] if m else pattern
    out, k, inside = [], 0, False
    while k < len(rest):
        c = rest[k]
        if c == "\\":
            out.append(rest[k : k + 2])
            k += 2
            continue
        if inside:
            if c == "[":
                c = "\\["
            elif c == "]":
                inside = False
        elif c == "[":
            inside = True
            out.append(c)
            k += 1
            if k < len(rest) and rest[k] == "^":
                out.append("^")
                k += 1
            if k < len(rest) and rest[k] == "]":
                out.append("\\]")
                k += 1
            continue
        elif "x" in flags and c.isspace():
            k += 1
            continue
        elif "x" in flags and c == "#":
            k = rest.find("\n", k) if "\n" in rest[k:] else len(rest)
            continue
        out.append(c)
        k += 1
    keep = "".join(f for f in "is" if f in flags)
    return f"(?{'d' + keep + 'U' if unicode else keep})" * bool(unicode or keep) + "".join(out)


def finds(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` (a verbose or plain Python one) occurs in the text; false for null."""
    return F.coalesce(text.rlike(flattened(pattern)), F.lit(False))
