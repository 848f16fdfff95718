"""Recall and precision audits of a lexicon, and the counters of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import dictionary as D
from parlance.functions.lexicon import Lexicon, unicode
from parlance.functions.text import month, normalize, stripped_sentences
from parlance.operators.samples import every_nth
from parlance.sources.scratch import hinted, settled

# Capitals that are vocabulary, and capitals that are anger.
TECH_CAPS = """
API JSON HTML CSS SQL HTTP HTTPS URL URI ID UUID CSV PDF CLI MCP LLM AI UI UX
JS TS PR CI CD OK TODO FIXME NOTE XXX README MIT GPU CPU RAM SSH SSL TLS DNS IP
OS VM DB ORM CRUD REST GET POST PUT DELETE PATCH HEAD XML YAML TOML ENV PATH
HOME USER NULL NAN EOF ASCII UTF PNG JPG JPEG SVG GIF WEBP MB GB KB TB MS AM PM
UTC USA FIPSE DOE JV PIDM WTE SSO MFA GEO SEO GSD UAT ADR PRD SPEC DOC DOCX XLSX
NPM PIP GIT SDK IDE JVM DOM CORS CSRF JWT OAUTH SAML LDAP SMTP IMAP FTP TCP UDP
RSS ATOM CDN DNS VPN LAN WAN USB SSD HDD BIOS UEFI ARM X86 AMD INTEL MAC IOS
ONLY ALL AND OR NOT IF THEN ELSE TRUE FALSE NONE YES NEW OLD ADD FIX USE RUN
""".split()
ANGRY_CAPS = """
STOP NO NOPE WHY WHAT DONT READ LISTEN SERIOUSLY AGAIN ENOUGH WRONG NEVER
FUCK FUCKING SHIT JESUS CHRIST GOD DAMN DAMNIT GODDAMN HELL WTF FFS
""".split()

# Constructions of praise, concession and admission that a dictionary may lack, in the published order.
PRAISE = r"(?:good|great|nice|excellent|fair|valid|solid|sharp|smart|wise|clever|strong|keen|astute)"
OPENERS = r"(?:good|right|fair|yes|yep|yeah|correct|agreed|true|indeed|noted|understood|exactly|ah|oh|oops|ouch|touche|granted|admittedly|ok|okay)"
CONSTRUCTIONS = {
    "praise+noun": r"\b" + PRAISE + r"\s+([a-z]{3,14})\b",
    "praise+to+verb": r"\b(?:" + PRAISE + r"|right)\s+(?:\w+\s+)?to\s+([a-z]{2,14})\b",
    "you+concede": r"\byou(?:re|\s+(?:are|were|had|caught|called|nailed|spotted))\s+([a-z]{2,14})\b",
    "i+fault": r"\bi\s+(?:was|were|should|shouldnt|didnt|failed|missed)\s+([a-z]{2,14})\b",
    "opener": r"^\W{0,3}(" + OPENERS + r"(?:\s+[a-z]{2,14}){0,2})\s*[-,:]",
    "exactly+": r"\bexactly\s+(right|correct|so|my|the point|what i)\b",
}


def shouting(raw: Column) -> Column:
    """The angry words in capitals of a message, or all its capitals if it is short and mostly capitals."""
    texts = lambda xs: F.array(*[F.lit(x) for x in dict.fromkeys(xs)])
    caps = F.filter(F.regexp_extract_all(raw, F.lit(unicode(r"\b[A-Z][A-Z']{2,}\b")), F.lit(0)), lambda w: ~F.array_contains(texts(TECH_CAPS), w))
    angry = F.filter(caps, lambda w: F.array_contains(texts(ANGRY_CAPS), F.replace(w, F.lit("'"), F.lit(""))))
    words = F.filter(F.split(raw, r"(?U)\s+"), lambda w: w != "")
    longish = F.size(F.filter(words, lambda w: F.length(F.regexp_replace(w, r"(?U)\W", "")) >= 3))
    mostly = (F.size(words) <= 25) & (longish > 0) & (F.size(caps) >= 0.6 * longish)
    return F.when(F.size(angry) > 0, angry).when(mostly, caps).otherwise(F.array().cast("array<string>"))


def near_misses(unmatched: DataFrame, text: str = "text", pattern: str = D.NEAR_MISS) -> DataFrame:
    """Sentences (the first 70 characters) that smell of an admission, of messages without a hit, with how often they occur."""
    told = unmatched.select(F.explode(stripped_sentences(normalize(F.col(text)))).alias("sentence"))
    told = told.filter(F.length("sentence").between(8, 200) & F.col("sentence").rlike(unicode(pattern)))
    return told.groupBy(F.substring("sentence", 1, 70).alias("sentence")).agg(F.count("*").alias("n"))


def sweep(messages: DataFrame, constructions: dict[str, str] = CONSTRUCTIONS, lexicon: Lexicon | None = None, text: str = "text") -> DataFrame:
    """kind, candidate, n and up to two samples (the least sentences) of what broad constructions find.

    A candidate is left out if the lexicon has a phrase within it; the rest of its sentence doesn't matter.
    """
    lex = lexicon or Lexicon()
    told = messages.select(F.explode(stripped_sentences(normalize(F.col(text)), " -*#`>|")).alias("norm")).filter(F.length("norm").between(4, 300))
    found = [F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("norm", F.lit(unicode(p)), F.lit(0)).alias("candidates")) for k, p in constructions.items()]
    hits = told.select("norm", F.explode(F.array(*found)).alias("f")).select("norm", "f.kind", F.explode("f.candidates").alias("candidate"))
    hits = hits.withColumn("candidate", F.trim("candidate")).filter(F.size(lex.phrase_hits("candidate")) == 0)
    sentences = settled(hits.groupBy("kind", "candidate", "norm").agg(F.count("*").alias("n")), "sweep")
    first = sentences.groupBy("kind", "candidate").agg(F.sum("n").alias("n"), F.min("norm").alias("first"))
    second = sentences.join(first.drop("n"), ["kind", "candidate"]).filter("norm > first").groupBy("kind", "candidate").agg(F.min("norm").alias("second"))
    return first.join(second, ["kind", "candidate"], "left").select("kind", "candidate", "n", F.array_compact(F.array("first", "second")).alias("samples"))


def precision_audit(hits: DataFrame, text: str, k: int, least: int = 1, most: int | None = None, phrase: str | None = None) -> DataFrame:
    """Up to k occurrences of every phrase found between ``least`` and ``most`` times, or of one ``phrase``, evenly spaced, each with its context.

    ``hits`` has phrase, start, file_id, line_no and the normalised text.
    """
    hits = hits if phrase is None else hits.filter(F.col("phrase") == phrase)
    n = hits.groupBy("phrase").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.lit(most).isNull() | (F.col("n") <= F.lit(most))))
    begin = F.greatest(F.col("start") - 75, F.lit(0))
    told = hits.join(hinted(n, 256), "phrase").withColumn("context", F.substring(F.col(text), begin + 1, F.col("start") + 65 - begin))
    return every_nth(told, ["phrase"], ["file_id", "line_no", "start"], F.lit(k)).select("phrase", "n", "file_id", "line_no", "start", "context")


def examples(hits: DataFrame, by: str, shown: str, k: int = 3) -> DataFrame:
    """The k least distinct values shown for each key: partial aggregates only, whatever a key's share."""
    out = None
    rest = hits.select(by, shown).distinct()
    for _ in range(k):
        first = rest.groupBy(by).agg(F.min(shown).alias(shown))
        out = first if out is None else out.unionByName(first)
        rest = rest.join(first, [by, shown], "left_anti")
    return out


def scan_counters(messages: DataFrame, hits: DataFrame, dimensions: tuple[str, ...] = ("model", "project", "month")) -> DataFrame:
    """dimension, value, messages, characters, hits and hit messages of each dimension alone, in one aggregation of grouping sets.

    Dimensions are columns of ``messages``; those that ``hits`` alone has (category, phrase) have hits and hit messages, and no
    messages of their own. A dimension 'all' is everything.
    """
    with_month = lambda df: df.withColumn("month", month(F.col("ts"))) if "month" in dimensions and "month" not in df.columns else df

    def by_dimension(df: DataFrame, *sums: Column) -> DataFrame:
        names = [d for d in dimensions if d in df.columns]
        grouped = df.groupingSets([[d] for d in names] + [[]] * ("all" in dimensions), *names).agg(F.grouping_id().alias("g"), *sums)
        bits = {d: (1 << len(names)) - 1 - (1 << (len(names) - 1 - i)) for i, d in enumerate(names)}
        name, value = F.lit("all"), F.lit(None).cast("string")
        for d, g in bits.items():
            name, value = F.when(F.col("g") == g, d).otherwise(name), F.when(F.col("g") == g, F.col(d).cast("string")).otherwise(value)
        return grouped.withColumns({"dimension": name, "value": value}).drop("g", *names)

    total = by_dimension(with_month(messages), F.count("*").alias("messages"), F.sum(F.length("text")).alias("characters"))
    found = by_dimension(with_month(hits), F.count("*").alias("hits"), F.countDistinct("fingerprint").alias("hit_messages"))
    on = (F.col("t.dimension") == F.col("h.dimension")) & F.col("t.value").eqNullSafe(F.col("h.value"))
    met = total.alias("t").join(found.alias("h"), on, "full")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select(F.coalesce("t.dimension", "h.dimension").alias("dimension"), F.coalesce("t.value", "h.value").alias("value"), "messages", "characters", none("hits"), none("hit_messages"))


def user_control(messages: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """The control phrases' hits on the user side, by category and phrase."""
    lex = lexicon or Lexicon()
    told = messages.filter("side = 'user'").withColumn("norm", normalize(F.col("text"))).select("fingerprint", F.explode(lex.phrase_hits("norm", "user")).alias("h"))
    return told.groupBy("h.category", "h.phrase").agg(F.count("*").alias("hits"), F.countDistinct("fingerprint").alias("messages"))
