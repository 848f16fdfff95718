"""The dictionary as a table function for SQL: ``select m.*, h.* from messages m, lateral match_rows(m.text) h``.

A second, plain implementation of what :class:`parlance.functions.lexicon.Lexicon` says in expressions, row by row in Python
workers: for SQL users and for differential tests. Jobs over whole corpora use the expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parlance.functions.lexicon import Lexicon, alternation, entries, whole
from parlance.functions.text import normalize_text

SCHEMA = "phrase string, category string, construct string, char_offset int, snippet string"
#: Characters around a hit that its guard is looked for in; of a snippet before and after a hit.
GUARD_REACH, BEFORE, AFTER = 80, 40, 200


class Matcher:
    """Compiled patterns of a lexicon's assistant side."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.phrases = [(p, c, re.compile(whole(normalize_text(p))), self.guard(lexicon, p)) for p, c in entries(lexicon.assistant)]
        self.families = [(c, re.compile(rx)) for c, patterns in lexicon.families.items() for rx in patterns.values()]
        self.openers = {normalize_text(w): c for c, ws in lexicon.openers.items() for w in ws}
        self.opener = re.compile(rf"(?:^|[.!?]\s+)({alternation(list(self.openers))})\s*[-,.:]") if self.openers else None
        self.constructs = {c: name for name, cs in lexicon.constructs.items() for c in cs}

    @staticmethod
    def guard(lexicon: Lexicon, phrase: str) -> re.Pattern | None:
        words = lexicon.guards.get(normalize_text(phrase))
        return re.compile("|".join(re.escape(normalize_text(w)).replace(r"\ ", r"\s+") for w in words)) if words else None

    def hits(self, norm: str) -> list[tuple[str, str, int]]:
        """(phrase, category, start): phrases longest first where none lies, less guarded ones, then families, then openers over none of those."""
        taken: list[tuple[int, int]] = []
        out: list[tuple[str, str, int]] = []
        for phrase, category, pattern, guard in self.phrases:
            for m in pattern.finditer(norm):
                if all(m.end() <= a or b <= m.start() for a, b in taken):
                    taken.append(m.span())
                    if not (guard and guard.search(norm[max(0, m.start() - GUARD_REACH) : m.start() + GUARD_REACH])):
                        out.append((phrase, category, m.start()))
        clear = lambda start, end: all(end <= s or s + len(p) <= start for p, _, s in out)
        found = [(m[0].strip(), c, m.start()) for c, rx in self.families for m in rx.finditer(norm) if clear(m.start(), m.end())]
        out += found
        if self.opener:
            words = [(f"{m[1]} -", self.openers[m[1]], m.start(1)) for m in self.opener.finditer(norm)]
            out += [(p, c, s) for p, c, s in words if clear(s, s + len(p))]
        return out


def register(spark: SparkSession, lexicon: Lexicon | None = None, name: str = "match_rows") -> None:
    """Register ``name`` for SQL: a row for each hit of the assistant's dictionary in a text; null and empty texts have none."""
    lex = lexicon or Lexicon()

    class MatchRows:
        def __init__(self) -> None:
            self.matcher = Matcher(lex)

        def eval(self, text: str | None) -> Iterator[tuple]:
            text = text or ""
            for phrase, category, start in self.matcher.hits(normalize_text(text)):
                low = max(0, start - BEFORE)
                yield phrase, category, self.matcher.constructs.get(category, "other"), start, text[low : start + AFTER]

    spark.udtf.register(name, F.udtf(MatchRows, returnType=SCHEMA))
