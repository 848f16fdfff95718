"""Places of regular-expression matches in a text, which Spark has no function for, from built-in functions.

A text split at its matches gives the gaps between them; gaps and matches summed from the left give every start. Spans are
SQL expressions, so that patterns may also be columns (fields of a dictionary entry inside a lambda).
"""

from __future__ import annotations


def quoted(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str, fields: str = "") -> str:
    """SQL for the array of struct(start, end, token, ...) of the non-overlapping matches, offsets in code points from 0.

    ``text`` and ``pattern`` are SQL expressions; ``fields`` are further SQL fields of each struct, with their leading comma.
    """
    hits = f"regexp_extract_all({text}, {pattern}, 0)"
    gaps = f"transform(slice(split({text}, {pattern}, -1), 1, size({hits})), y -> length(y))"
    step = f"struct(a.at + x.gap + length(x.token) as at, array_append(a.out, struct(a.at + x.gap as start, a.at + x.gap + length(x.token) as end, x.token as token{fields})) as out)"
    none = f"filter(array(struct(0 as start, 0 as end, '' as token{fields})), z -> false)"
    return f"aggregate(zip_with({gaps}, {hits}, (g, h) -> struct(g as gap, h as token)), struct(0 as at, {none} as out), (a, x) -> {step}, a -> a.out)"


def claimed(candidates: str) -> str:
    """SQL that keeps, in the order of ``candidates``, each span that overlaps none kept before it."""
    fresh = "not exists(a, c -> s.start < c.end and c.start < s.end)"
    return f"aggregate({candidates}, filter({candidates}, z -> false), (a, s) -> if({fresh}, array_append(a, s), a))"
