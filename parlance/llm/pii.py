"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Base kinds (email, ip, card, phone) are always reported. The method adds spans of further kinds
(iban, ssn, routing) if their score, after checksum and context, reaches ``MIN_SCORE``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import map_rows, texts_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "routing")
MIN_SCORE = 0.6
#: Code points before and after a span in which context words are looked for.
CONTEXT = 48

# Words that make a kind likelier.
CONTEXT_WORDS = {
    "email": ("email", "mail", "contact", "write", "reply"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "routing": ("routing", "aba", "bank"),
}
#: The words as whole words, plurals too: "cabana" is no "aba", nor "tip" an "ip".
NEAR = {kind: re.compile(rf"(?<![^\W_])(?:{'|'.join(words)})s?(?![^\W_])") for kind, words in CONTEXT_WORDS.items()}
#: Score of a confirmed span without context; context adds CONTEXT_BONUS.
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "routing": 0.4}
CONTEXT_BONUS = 0.2

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits fails or matches as one, so the lookbehind only spares tries inside a run.
IP = re.compile(r"(?<![0-9])[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: country and check digits to the end, letters as 10..35, remainder 1."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def aba(digits: str) -> bool:
    """The check digit of US bank routing numbers."""
    return any(c != "0" for c in digits) and sum(int(c) * w for c, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0


def octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ in turn so that long runs cost no retries."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind, then start; (kind, start, end) in code points, end exclusive."""
    yield from (("email", *span) for span in emails(text))
    if not re.search("[0-9]", text):
        return
    for m in IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0]):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()
    for m in ROUTING.finditer(text):
        if aba(m[0]):
            yield "routing", *m.span()


def scored(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Spans with their score; added kinds only from MIN_SCORE on."""
    for kind, start, end in proposals(text):
        near = f"{text[max(0, start - CONTEXT):start]} {text[end:end + CONTEXT]}".lower()
        score = min(1.0, START_SCORE[kind] + CONTEXT_BONUS * bool(NEAR[kind].search(near)))
        if kind in BASE or score >= MIN_SCORE:
            yield kind, start, end, score


SPANS_SCHEMA = "doc_id long, kinds array<string>, starts array<long>, ends array<long>, scores array<double>"


def find_pii(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id and the arrays kinds, starts, ends, scores, by kind as listed, then start.

    Null and empty texts have empty arrays; null ids and repeated rows stay as they are; other columns are ignored.
    Whole texts are scanned, whatever their length. No shuffle.
    """

    def scan(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for ids, texts in batches:
            yield [(i, *(map(list, zip(*found)) if found else ([], [], [], []))) for i, found in ((i, list(scored(t))) for i, t in zip(ids, texts))]

    return map_rows(texts_of(documents, id_column, text_column), scan, SPANS_SCHEMA)


def pii_digest(found: DataFrame) -> DataFrame:
    """The counts and span digests of :func:`find_pii`'s rows, as built-in expressions."""
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    rows = F.arrays_zip("kinds", "starts", "ends")
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(said(F.filter(rows, lambda x: x["kinds"].isin(*BASE))), 256).alias("base_sha256"),
        said(rows).alias("spans"),
        F.array_join(F.transform("scores", lambda s: F.format_number(s, 1)), ",").alias("scores"),
    )


def digest_of(text: str) -> str:
    """The base digest of one text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in proposals(text) if k in BASE).encode()).hexdigest()
