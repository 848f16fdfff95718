"""Text normalisation, tokens, hashes and time helpers, all as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what they are straightened to; injected wrapper tags; stop words of both word variants.
SMART_FROM, SMART_TO = "’‘“”—– ", "''\"\"-- "
PAIRED_TAGS = "system-reminder|command-name|command-message|command-args|local-command-stdout|local-command-stderr|user-prompt-submit-hook|task-notification"
STRAY_TAGS = "system-reminder|command-[a-z]+|local-command-[a-z]+|task-notification|task-id|tool-use-id|output-file"
STOP_WORDS = """the a an and or but if then this that these those with from into for to of in on
at by is are was were be been being it its as not no you your yours i me my we our they them
he she do does did done have has had can could should would will just also so than too very
what when where which who why how all any both each more most other some such only own same
now here there let lets me""".split()
FURTHER_STOP_WORDS = """need want make made get got go going know think see look
like use used using still yet even back one two new old first last thing things way ways
please thanks ok okay yes yeah right dont im ive youre thats hes shes weve theyre""".split()
TONE_WORDS = """fuck fucking fucked fuckin shit shitty crap bullshit damn
damnit hell wtf stupid dumb moron idiot lazy useless pathetic jesus christ god
love sake infuriating frustrating annoying seriously literally""".split()


def normalize(text: Column) -> Column:
    """Straight quotes and dashes, no apostrophes, lower case, runs of white space as one blank; not trimmed."""
    straight = F.translate(text, SMART_FROM, SMART_TO)
    return F.regexp_replace(F.lower(F.replace(straight, F.lit("'"), F.lit(""))), r"(?U)\s+", " ")


def normalize_text(text: str) -> str:
    """The same for one dictionary entry, on the driver."""
    return re.sub(r"\s+", " ", text.translate(str.maketrans(SMART_FROM, SMART_TO)).replace("'", "").lower()) if text else ""


def strip_wrappers(text: Column) -> Column:
    """Injected tags with what they enclose, then leftover tags, each replaced by a blank."""
    inner = F.regexp_replace(text, rf"(?s)<({PAIRED_TAGS})>.*?</\1>", " ")
    return F.regexp_replace(inner, f"</?(?:{STRAY_TAGS})>", " ")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_code(text: Column) -> Column:
    """Fenced blocks, then inline code, each replaced by a blank."""
    return F.regexp_replace(F.regexp_replace(text, "(?s)```.*?```", " "), "`[^`]*`", " ")


def sentences(text: Column) -> Column:
    return F.split(text, r"[.!?\n]+", -1)


def stripped_sentences(text: Column, marks: str = " -*#`>") -> Column:
    """Sentences without the marks around them."""
    return F.transform(sentences(text), lambda s: F.trim(s, F.lit(marks)))


def fingerprint(uuid: Column) -> Column:
    """Identity of a message: the first 16 hexadecimal digits of its id's SHA-1."""
    return F.substring(F.sha1(uuid), 1, 16)


def dashed(path: Column) -> Column:
    """A path as a name: a dash for each character that is no ASCII letter or digit, none around it."""
    return F.trim(F.regexp_replace(path, "[^A-Za-z0-9]", "-"), F.lit("-"))


def rooted(path: Column) -> Column:
    """A path as a name of a root: a dash for each slash and full stop only."""
    return F.translate(path, "/.", "--")


def encoded(path: Column) -> Column:
    """A path as a project's name: as :func:`dashed`, but with the dashes around it."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def content_words(norm: Column, variant: int = 1) -> Column:
    """Distinct words of four or more ASCII letters in normalised text, less stop words; variant 2 drops more of them."""
    drop = STOP_WORDS + (FURTHER_STOP_WORDS + TONE_WORDS if variant == 2 else [])
    words = F.array_distinct(F.regexp_extract_all(norm, F.lit("[a-z]{4,}"), F.lit(0)))
    return F.array_except(words, F.array(*[F.lit(w) for w in dict.fromkeys(drop) if len(w) >= 4]))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common entries of two arrays without repeats, to three decimals; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, F.round(both / union, 3)).otherwise(0.0)


def month(ts: Column) -> Column:
    """The month of an ISO timestamp, or 'unknown'."""
    return F.when(F.length(ts) >= 7, F.substring(ts, 1, 7)).otherwise("unknown")


def month_span(first: Column, last: Column) -> Column:
    """Full months between two ISO dates: a month counts once its day is reached."""
    part = lambda c, at, n: F.substring(c, at, n).cast("int")
    return (part(last, 1, 4) - part(first, 1, 4)) * 12 + part(last, 6, 2) - part(first, 6, 2) - F.when(part(last, 9, 2) < part(first, 9, 2), 1).otherwise(0)


def days_in_month(month: Column) -> Column:
    """Days of a month (ISO), February always with 28; null if it is none."""
    n = F.try_element_at(F.split(month, "-"), F.lit(2)).try_cast("int")
    return F.when(n == 2, 28).when(n.isin(4, 6, 9, 11), 30).when(n.between(1, 12), 31)


def short_model(model: Column, prefix: str) -> Column:
    """A model's name without its maker's prefix."""
    return F.replace(model, F.lit(prefix), F.lit(""))


def machine_id(name: Column) -> Column:
    """A stable name of a machine that doesn't tell its own: eight hexadecimal digits."""
    return F.substring(F.sha2(name, 256), 1, 8)


def hidden(name: Column) -> Column:
    """A name as twelve hexadecimal digits, to be told apart and looked up by those who know it."""
    return F.substring(F.sha2(name, 256), 1, 12)


def parse_ts(ts: Column) -> Column:
    """The first 19 characters of an ISO timestamp as a timestamp, else null."""
    return F.try_to_timestamp(F.substring(ts, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def gap(seconds: Column) -> Column:
    """A span of time in whole minutes under two hours, hours under two days, else days."""
    minutes = F.floor(seconds / 60)
    told = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    return F.when(minutes < 120, told(minutes, "m")).when(minutes < 2880, told(F.floor(minutes / 60), "h")).otherwise(told(F.floor(minutes / 1440), "d"))


def snippet(flat: Column, at: Column, before: int = 40, after: int = 200) -> Column:
    """The text around an offset (from 0)."""
    start = F.greatest(at - before, F.lit(0))
    return F.substring(flat, start.cast("int") + 1, (at + after - start).cast("int"))
