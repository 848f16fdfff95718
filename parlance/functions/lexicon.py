"""A dictionary compiled to Catalyst expressions: phrase, opener, guard and heat matching over normalised text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from parlance.functions import dictionary as D
from parlance.functions.spans import claimed, quoted, spans
from parlance.functions.text import normalize_text

HIT = "array<struct<phrase:string,category:string,start:int>>"


def escaped(words: str) -> str:
    """A pattern for the words, any white space between them; full of characters both regex dialects read alike."""
    return re.sub(r"([^\w\s])", r"\\\1", words).replace(" ", r"\s+")


def whole(norm: str) -> str:
    """A pattern for a normalised phrase that is not inside a longer word."""
    return f"(?<![a-z0-9]){escaped(norm)}(?![a-z0-9'])"


def first_token(norm: str) -> str:
    """The run of letters and digits that a normalised phrase begins with, perhaps none: wherever the phrase matches, it is a whole token of the text."""
    return re.match("[a-z0-9]*", norm)[0]


def alternation(words: list[str]) -> str:
    """Longest first; equal lengths in the order given."""
    return "|".join(escaped(w) for w in sorted(words, key=len, reverse=True))


def unicode(pattern: str) -> str:
    """Java classes that take Unicode white space and letters."""
    return f"(?U){pattern}"


def entries(groups: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(phrase, category), longest phrase first, equal lengths in the order of loading; keys that begin with _ are notes."""
    return sorted(((p, c) for c, ps in groups.items() if not c.startswith("_") for p in ps), key=lambda x: -len(x[0]))


@dataclass
class Lexicon:
    """Phrases by side and category, with their openers, guards, families and constructs. Every list may be replaced."""

    assistant: dict[str, list[str]] = field(default_factory=lambda: D.ASSISTANT)
    user: dict[str, list[str]] = field(default_factory=lambda: D.USER)
    pushback_openers: list[str] = field(default_factory=lambda: D.PUSHBACK_OPENERS)
    openers: dict[str, list[str]] = field(default_factory=lambda: D.OPENERS)
    guards: dict[str, list[str]] = field(default_factory=lambda: D.GUARDS)
    families: dict[str, dict[str, str]] = field(default_factory=lambda: D.PATTERNS)
    constructs: dict[str, list[str]] = field(default_factory=lambda: D.CONSTRUCTS)
    heat: dict[str, list[str]] = field(default_factory=lambda: D.HEAT)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lexicon:
        """From a dictionary file (JSON) anywhere Spark reads; it is small and read whole. Keys that begin with _ are notes."""
        raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
        plain = lambda x: {k: v for k, v in x.items() if not k.startswith("_")}
        return cls(
            plain(raw.get("assistant", {})), plain(raw.get("user", {})), raw.get("user_pushback_openers", []), plain(raw.get("assistant_openers", {})),
            plain(raw.get("assistant_negation_guard", {})), plain(raw.get("assistant_patterns", {})), plain(raw.get("_constructs", {})),
        )

    def construct(self, category: Column) -> Column:
        """The construct of a category, else 'other'."""
        out = F.lit("other")
        for name, categories in self.constructs.items():
            out = F.when(category.isin(categories), name).otherwise(out)
        return out

    def phrases_sql(self, side: str) -> str:
        """SQL for the constant array of a side's phrases, in order of priority."""
        rows = []
        for phrase, category in entries(getattr(self, side)):
            norm = normalize_text(phrase)
            guard = "|".join(escaped(normalize_text(w)) for w in self.guards.get(norm, [])) if side == "assistant" else ""
            fields = {"phrase": phrase, "category": category, "norm": norm, "rx": whole(norm), "guard": guard, "first": first_token(norm)}
            rows.append(f"struct({', '.join(f'{quoted(v)} as {k}' for k, v in fields.items())})")
        return f"array({', '.join(rows)})"

    def phrase_hits(self, text: str = "norm", side: str = "assistant") -> Column:
        """HIT of the phrases in a column of normalised text: longest phrase first, each only where no earlier one lies.

        Phrases are indexed by their first token: of a text's tokens, those that begin a phrase are told once, and the text
        meets the phrases of these tokens alone. Normalised text has single blanks, so that an entry can only match where its
        plain text occurs; patterns run on those.
        """
        tokens = sorted({first_token(normalize_text(p)) for p, _ in entries(getattr(self, side))})
        begun = f"array_intersect(array({', '.join(map(quoted, tokens))}), split({text}, '[^a-z0-9]+', -1))"
        plain = f"array_union({begun}, array(''))"  # phrases that begin with no token always meet the text
        fields = ", p.phrase as phrase, p.category as category, p.guard as guard"
        # the tokens are a variable of the outer lambda, so that they are told once a text
        found = f"flatten(transform(array({plain}), b -> filter({self.phrases_sql(side)}, p -> array_contains(b, p.first) and contains({text}, p.norm))))"
        candidates = f"flatten(transform({found}, p -> {spans(text, 'p.rx', fields)}))"
        return F.expr(claimed(candidates))

    def assistant_hits(self, text: str = "norm") -> Column:
        """HIT of guarded phrases, then regex families, then sentence-initial openers, none over a span claimed before.

        A family's or an opener's overlap is judged by the length of phrases as written.
        """
        t = F.col(text)
        near = lambda h: F.substring(t, F.greatest(h["start"] - 80, F.lit(0)) + 1, h["start"] + 80 - F.greatest(h["start"] - 80, F.lit(0)))
        told = lambda hs: F.transform(hs, lambda h: F.struct(h["phrase"].alias("phrase"), h["category"].alias("category"), h["start"].alias("start")))
        out = told(F.filter(self.phrase_hits(text), lambda h: (h["guard"] == "") | ~F.regexp_like(near(h), h["guard"])))
        clear = lambda hits, start, end: ~F.exists(hits, lambda c: (start < c["start"] + F.length(c["phrase"])) & (c["start"] < end))
        families = F.array().cast(HIT)
        for category, patterns in self.families.items():
            for pattern in patterns.values():
                hits = F.expr(spans(text, quoted(unicode(pattern))))
                fresh = F.filter(hits, lambda s: clear(out, s["start"], s["end"]))
                named = F.lit(category)
                families = F.concat(families, F.transform(fresh, lambda s: F.struct(F.trim(s["token"]).alias("phrase"), named.alias("category"), s["start"].alias("start"))))
        out = F.concat(out, families)
        words = {normalize_text(w): c for c, ws in self.openers.items() for w in ws}
        if words:
            rx = rf"(?:^|[.!?]\s+)({alternation(list(words))})\s*[-,.:]"
            category = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
            word = lambda s: F.regexp_extract(s["token"], rx.replace("(?:^|", "^(?:|"), 1)
            lead = lambda s: F.length(F.regexp_extract(s["token"], r"^(?:[.!?]\s+)?", 0))
            opened = F.transform(F.expr(spans(text, quoted(rx))), lambda s: F.struct(F.concat(word(s), F.lit(" -")).alias("phrase"), category[word(s)].alias("category"), (s["start"] + lead(s)).alias("start")))
            out = F.concat(out, F.filter(opened, lambda h: clear(out, h["start"], h["start"] + F.length(h["phrase"]))))
        return out

    def gate(self, text: str = "norm") -> Column:
        """A cheap test that every text with an assistant hit passes."""
        words = [w for ws in self.openers.values() for w in ws]
        plain = "|".join(escaped(normalize_text(p)) for p, _ in entries(self.assistant))
        opener = rf"(?:^|[.!?]\s+)(?:{alternation([normalize_text(w) for w in words])})\s*[-,.:]" if words else r"(?!)"
        others = "|".join(p for ps in self.families.values() for p in ps.values())
        return F.col(text).rlike(f"(?<![a-z0-9])(?:{plain})|{opener}" + (f"|{others}" if others else ""))

    def pushes_back(self, text: str = "norm") -> Column:
        """Whether a user message opens with pushback."""
        words = alternation([normalize_text(w) for w in self.pushback_openers])
        return F.col(text).rlike(unicode(rf"^\W{{0,3}}(?:{words})(?![a-z0-9'])"))

    def heat_sql(self, text: str) -> str:
        """SQL for HIT of heated words in normalised text, an SQL expression that may be a lambda variable.

        Categories are matched one by one and may overlap; a word is void if its guard matches within 40 characters of its
        start, and some words also need a person near.
        """
        parts = []
        for category, words in self.heat.items():
            rx = rf"(?<![a-z0-9])(?:{alternation([normalize_text(w) for w in words])})(?![a-z0-9])"
            parts.append(f"transform({spans(text, quoted(rx))}, s -> struct(s.token as phrase, {quoted(category)} as category, s.start as start))")
        window = f"substring({text}, greatest(h.start - 40, 0) + 1, h.start + 40 - greatest(h.start - 40, 0))"
        tests = [f"when {quoted(w)} then not {window} rlike {quoted(unicode(rx))}" for w, rx in D.HEAT_GUARDS.items() if w not in D.HEAT_NEEDS]
        for w, rx in D.HEAT_NEEDS.items():
            guard = f"not {window} rlike {quoted(unicode(D.HEAT_GUARDS[w]))} and " if w in D.HEAT_GUARDS else ""
            tests.append(f"when {quoted(w)} then {guard}{window} rlike {quoted(unicode(rx))}")
        return f"filter(concat({', '.join(parts)}), h -> case h.phrase {' '.join(tests)} else true end)"

    def heat_hits(self, text: str = "norm") -> Column:
        return F.expr(self.heat_sql(text))

    def heat_by_sentence(self, text: str = "norm") -> Column:
        """struct(hits, directed): heat hits sentence by sentence, and whether one of their sentences has a second person."""
        told = f"transform(split({text}, '[.!?\\\\n]+', -1), t -> struct({self.heat_sql('t')} as hits, t rlike {quoted(unicode(D.SECOND_PERSON))} as aimed))"
        return F.expr(f"aggregate({told}, struct(cast(array() as {HIT}) as hits, false as directed), (a, x) -> struct(concat(a.hits, x.hits) as hits, a.directed or (x.aimed and size(x.hits) > 0) as directed))")


def shouts(body: str) -> Column:
    """HIT of shouts in a column of raw text without code: short ones that are a whole segment, longer ones unless in logs."""
    bare = r"regexp_replace(regexp_replace(x.token, '(?U)^\\s+|\\s+$', ''), '^[*_–— \\t-]+|[*_–— \\t-]+$', '')"
    solo = f"transform({spans(body, quoted('[^' + chr(92) + 'n.!?]+'))}, x -> struct({bare} as phrase, 'shouting' as category, x.start as start))"
    solo = f"filter({solo}, x -> x.phrase in ({', '.join(quoted(w) for w in D.SOLO_SHOUTS)}))"
    near = f"lower(substring({body}, greatest(x.start - 60, 0) + 1, x.start + 60 - greatest(x.start - 60, 0)))"
    inline = f"filter({spans(body, quoted(unicode(rf'(?<![A-Za-z])(?:{alternation(D.INLINE_SHOUTS)})(?![A-Za-z])')))}, x -> not {near} rlike {quoted(D.LOG_OUTPUT)})"
    return F.expr(f"concat({solo}, transform({inline}, x -> struct(x.token as phrase, 'shouting' as category, x.start as start)))")


def correction(norm: Column) -> Column:
    return norm.rlike(unicode(D.CORRECTION))


def markers(norm: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that occur, in their order."""
    return F.array_compact(F.array(*[F.when(norm.rlike(unicode(p)), name) for name, p in patterns.items()]))
