"""The registered queries of the engine's operators and their DuckDB SQL, over the driver's tables.

Conversations stand for transcripts (conv_id: file, turn: line, system: a synthetic message), documents for a corpus with
projects, orders for models and months, events for timelines. A probe lexicon of words that occur takes the dictionary's place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import dictionary as D
from parlance.functions import text as T
from parlance.functions.lexicon import Lexicon
from parlance.operators import checks, followthrough, matches, rates, samples, turns
from parlance.plans import stats_plans
from parlance.sources.scratch import shared_folder
from parlance.streaming import conversations as streaming

PROBE = Lexicon(
    assistant={"agreement": ["that", "in the"], "apology": ["to"], "validation": ["the", "is"]}, user={}, openers={"agreement": ["the"], "compliance": ["of"]},
    guards={}, families={}, constructs={"concession": ["agreement", "apology"], "flattery": ["validation"]}, heat={"heat": ["the", "is"]},
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as messages with their files' columns; system messages are left out."""
    c = table(spark, d, "conversations").filter("role != 'system'")
    mod = lambda k, p: F.concat(F.lit(p), F.pmod("conv_id", F.lit(k)).cast("string"))
    at = F.timestamp_seconds(1_700_000_000 + F.pmod("conv_id", F.lit(97)) * 7200 + F.col("turn") * 60)
    return c.select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("line_no"), F.col("role").alias("side"), "text", mod(3, "m").alias("machine_id"), mod(2, "r").alias("root_slug"),
        mod(5, "p").alias("project"), F.col("conv_id").cast("string").alias("session"), mod(4, "model").alias("model"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        T.fingerprint(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("fingerprint"),
    )


def word(column: str, w: str):
    return F.col(column).rlike(f"(?<![a-z0-9]){w}(?![a-z0-9'])")


def probed(spark: SparkSession, d: str) -> DataFrame:
    """Messages with norm, turn_id, depth, their turn's bucket, and whether they concede."""
    told = turns.with_turns(messages(spark, d)).withColumn("norm", T.normalize(F.col("text")))
    bucket = F.when(F.size(PROBE.heat_hits("norm")) > 0, "hot").when(word("norm", "of"), "correction").otherwise("neutral")
    told = told.withColumns({"bucket": F.when(F.col("side") == "user", bucket), "conceded": (F.col("side") == "assistant") & word("norm", "that")})
    return turns.with_user_context(told, ["bucket", "text"])


Q = "chr(39)"
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm_sql(x: str) -> str:
    return f"regexp_replace(lower(replace(translate({x}, '’‘“”—–' || chr(160), {Q} || {Q} || '\"\"-- '), {Q}, '')), '{WS}', ' ', 'g')"


def word_sql(w: str, x: str = "norm") -> str:
    return f"regexp_matches({x}, '(^|[^a-z0-9]){w}($|[^a-z0-9])')"


def count_sql(w: str, x: str = "norm") -> str:
    """Occurrences of a phrase: characters around words are doubled first, so that neighbours don't share one."""
    return f"len(regexp_extract_all(regexp_replace({x}, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){w.replace(' ', '  ')}($|[^a-z0-9])'))"


def wilson_sql(k: str, n: str) -> str:
    p, zz = f"({k}::double / {n})", "3.8416"
    half = f"(1.96 * sqrt({p} * (1 - {p}) / {n} + {zz} / (4.0 * {n} * {n})))"
    low, high = (f"(100 * (({p} + {zz} / (2 * {n})) {s} {half}) / (1 + {zz} / {n}))" for s in "-+")
    return f"round(100.0 * {k} / {n}, 4) as rate, round(greatest(0.0, {low}), 4) as low, round(least(100.0, {high}), 4) as high"


MSG = f"""with msg as (
  select conv_id as file_id, turn as line_no, role as side, text, 'm' || (conv_id % 3) as machine_id, 'p' || (conv_id % 5) as project,
    substr(sha1(conv_id || ':' || turn), 1, 16) as fingerprint, {norm_sql('text')} as norm from conversations where role <> 'system'),
turned as (select *, cast(sum(case when side = 'user' then 1 else 0 end) over (partition by file_id order by line_no) as bigint) as turn_id from msg),
deep as (select *, case when side = 'user' then 0 else cast(sum(case when side = 'assistant' then 1 else 0 end) over (partition by file_id, turn_id order by line_no) as int) end as depth from turned),
usr as (select file_id, turn_id, text as user_text, case when {word_sql('the')} or {word_sql('is')} then 'hot' when {word_sql('of')} then 'correction' else 'neutral' end as user_bucket from deep where side = 'user'),
probed as (select d.*, u.user_text, u.user_bucket, side = 'assistant' and {word_sql('that')} as conceded from deep d left join usr u using (file_id, turn_id))
"""


# ---- text


@query(MSG + "select file_id, line_no, norm from msg")
def normalize_text(spark, d):
    return messages(spark, d).select("file_id", "line_no", T.normalize(F.col("text")).alias("norm"))


def _wrapped(x: str) -> str:
    for tag in T.PAIRED_TAGS.split("|"):
        x = f"regexp_replace({x}, '<{tag}>.*?</{tag}>', ' ', 'gs')"
    return f"regexp_replace({x}, '</?(?:{T.STRAY_TAGS})>', ' ', 'g')"


@query(f"select page_id, md5({_wrapped('w')}) as digest, length({_wrapped('w')}) as n from (select page_id, '<system-reminder>' || url || chr(10) || '</system-reminder>' || html || '<task-id>' as w from pages)")
def strip_wrappers(spark, d):
    w = F.concat(F.lit("<system-reminder>"), F.col("url"), F.lit("\n</system-reminder>"), F.col("html"), F.lit("<task-id>"))
    told = table(spark, d, "pages").select("page_id", T.strip_wrappers(w).alias("w"))
    return told.select("page_id", F.md5("w").alias("digest"), F.length("w").cast("long").alias("n"))


@query(f"select doc_id, md5(trim(regexp_replace(text, '{WS}', ' ', 'g'))) as digest from documents")
def collapse_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("digest"))


@query("select doc_id, substr(sha1(doc_id || source), 1, 16) as fp from documents")
def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.concat(F.col("doc_id").cast("string"), "source")).alias("fp"))


@query("select page_id, trim(regexp_replace(url, '[^A-Za-z0-9]', '-', 'g'), '-') as dashed, translate(url, '/.', '--') as rooted, regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') as encoded from pages")
def slugs(spark, d):
    return table(spark, d, "pages").select("page_id", T.dashed(F.col("url")).alias("dashed"), T.rooted(F.col("url")).alias("rooted"), T.encoded(F.col("url")).alias("encoded"))


def _words_sql(x: str, variant: int = 1) -> str:
    drop = T.STOP_WORDS + (T.FURTHER_STOP_WORDS + T.TONE_WORDS if variant == 2 else [])
    told = ", ".join(f"'{w}'" for w in dict.fromkeys(drop) if len(w) >= 4)
    return f"list_filter(list_distinct(regexp_extract_all({x}, '[a-z]{{4,}}')), lambda w: not list_contains([{told}], w))"


@query(MSG + f"select file_id, line_no, len({_words_sql('norm')}) as n, array_to_string(list_sort({_words_sql('norm')}), ' ') as words from msg")
def content_words(spark, d):
    words = T.content_words(T.normalize(F.col("text")))
    return messages(spark, d).select("file_id", "line_no", F.size(words).cast("long").alias("n"), F.array_join(F.array_sort(words), " ").alias("words"))


@query(r"select doc_id, len(regexp_split_to_array(text, '[.!?\n]+')) as n, md5(array_to_string(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: trim(s, ' -*#`>')), '|')) as digest from documents")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(T.stripped_sentences(F.col("text")), "|")).alias("digest"))


@query("select doc_id, md5(regexp_replace(regexp_replace('a `b` ```' || text || '``` c', '```.*?```', ' ', 'gs'), '`[^`]*`', ' ', 'g')) as digest from documents")
def strip_code(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_code(F.concat(F.lit("a `b` ```"), "text", F.lit("``` c")))).alias("digest"))


# ---- populations and turns


@query(MSG + "select side, count(*) as n, count(distinct file_id) as files, min(line_no) as first, max(line_no) as last from msg group by 1")
def population_counts(spark, d):
    return messages(spark, d).groupBy("side").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


@query(MSG + "select side, count(distinct fingerprint) as n from msg group by 1")
def side_distinct(spark, d):
    return rates.distinct_per(messages(spark, d), "side")


@query(MSG + "select side, cast(sum(n) as bigint) as n from (select machine_id, side, count(distinct fingerprint) as n from msg group by all) group by 1")
def machine_sums(spark, d):
    return rates.machine_sums(messages(spark, d))


@query(MSG + "select machine_id, project, side, count(distinct fingerprint) as n from msg group by all")
def per_group_denominators(spark, d):
    return rates.distinct_per(messages(spark, d), "machine_id", "project", "side")


@query(MSG + "select file_id, line_no, fingerprint from msg")
def first_occurrence_dedup(spark, d):
    m = messages(spark, d)
    twice = m.unionAll(m.withColumn("file_id", F.col("file_id") + 1_000_000_000))
    return turns.first_occurrence(twice).select("file_id", "line_no", "fingerprint")


@query(MSG + "select file_id, line_no, turn_id, depth from deep")
def depth_in_turn(spark, d):
    return turns.with_turns(messages(spark, d)).select("file_id", "line_no", "turn_id", "depth")


@query(MSG + "select least(depth, 6) as depth, count(*) as n from deep where side = 'assistant' group by 1")
def depth_histogram(spark, d):
    return rates.histogram(turns.with_turns(messages(spark, d)).filter("side = 'assistant'"), F.least("depth", F.lit(6)), "depth")


@query(MSG + "select file_id, line_no, user_bucket as bucket from probed where side = 'user'")
def turn_bucket(spark, d):
    return probed(spark, d).filter("side = 'user'").select("file_id", "line_no", F.col("user_bucket").alias("bucket"))


@query(MSG + "select file_id, line_no, user_text, user_bucket from probed where side = 'assistant'")
def prev_user_context(spark, d):
    return probed(spark, d).filter("side = 'assistant'").select("file_id", "line_no", "user_text", "user_bucket")


@query(MSG + "select file_id, turn_id, first_value(case when side = 'assistant' then text end ignore nulls) over (partition by file_id order by line_no rows between 1 following and unbounded following) as reply from turned qualify side = 'user'")
def next_reply(spark, d):
    return turns.next_reply(turns.with_turns(messages(spark, d)))


WORDS = _words_sql("norm")


@query(MSG + f""", w as (select file_id, line_no, {WORDS} as words from msg where side = 'user')
select a.file_id, a.line_no, round(coalesce(max(len(list_intersect(a.words, b.words))::double / nullif(len(list_distinct(list_concat(a.words, b.words))), 0)), 0.0), 3) as similarity
from w a left join w b on a.file_id = b.file_id and b.line_no < a.line_no group by 1, 2""")
def prior_turn_jaccard(spark, d):
    users = messages(spark, d).filter("side = 'user'").withColumn("words", T.content_words(T.normalize(F.col("text"))))
    return turns.prior_similarity(users)


# ---- matching

HITS = f"""{MSG}, hit as (
  select file_id, line_no, fingerprint, user_bucket, unnest([struct_pack(category := 'agreement', phrase := 'in the', n := {count_sql('in the')}), struct_pack(category := 'agreement', phrase := 'that', n := {count_sql('that')}),
    struct_pack(category := 'validation', phrase := 'the', n := {count_sql('the')} - {count_sql('in the')}), struct_pack(category := 'apology', phrase := 'to', n := {count_sql('to')}),
    struct_pack(category := 'validation', phrase := 'is', n := {count_sql('is')})], recursive := true) from probed where side = 'assistant'),
hits as (select * from hit where n > 0)
"""


def _hits(spark, d) -> DataFrame:
    told = probed(spark, d).filter("side = 'assistant'").select("file_id", "line_no", "fingerprint", "user_bucket", F.explode(PROBE.phrase_hits("norm")).alias("h"))
    return told.select("file_id", "line_no", F.col("fingerprint").alias("msg_fingerprint"), "user_bucket", F.lit("assistant").alias("side"), "h.phrase", "h.category", "h.start")


@query(HITS + "select file_id, line_no, category, phrase, n from hits")
def phrase_hits(spark, d):
    return _hits(spark, d).groupBy("file_id", "line_no", "category", "phrase").agg(F.count("*").alias("n"))


@query(HITS + "select 'assistant' as side, category, phrase, cast(sum(n) as bigint) as hits, count(distinct fingerprint) as messages from hits group by rollup (category, phrase) union all select null, null, null, cast(sum(n) as bigint), count(distinct fingerprint) from hits")
def tally_rollup(spark, d):
    return matches.tally(_hits(spark, d))


@query(HITS + "select phrase, cast(sum(n) as bigint) as n from hits group by 1 order by n desc, phrase limit 3")
def top_k_phrases(spark, d):
    return rates.top(_hits(spark, d).groupBy("phrase").agg(F.count("*").alias("n")), 3, F.desc("n"), F.col("phrase"))


@query(HITS + "select n, count(*) as messages from (select cast(sum(n) as bigint) as n from hits group by file_id, line_no) group by 1")
def hits_per_message(spark, d):
    return _hits(spark, d).groupBy("msg_fingerprint").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("messages"))


@query(HITS + "select user_bucket as bucket, cast(sum(n) as bigint) as n from hits where category in ('agreement', 'apology') group by 1")
def turn_composition(spark, d):
    return _hits(spark, d).filter(PROBE.construct(F.col("category")) == "concession").groupBy(F.col("user_bucket").alias("bucket")).agg(F.count("*").alias("n"))


@query(HITS + "select round(sum(case when user_bucket = 'neutral' then n else 0 end)::double / sum(n), 6) as share from hits where category in ('agreement', 'apology')")
def unexplained_share(spark, d):
    told = turn_composition(spark, d).agg(F.sum(F.when(F.col("bucket") == "neutral", F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("n"))
    return told.select(F.round(F.col("k") / F.col("n"), 6).alias("share"))


# Places are told by looking at every one, longer phrases first; a phrase's order is that of the dictionary's entries.
PLACES = f"""{MSG}, pat(o, category, phrase) as (values (0, 'agreement', 'in the'), (1, 'agreement', 'that'), (2, 'validation', 'the'), (3, 'apology', 'to'), (4, 'validation', 'is')),
spot as (select file_id, line_no, side, norm, unnest(range(0, length(norm))) as p from msg),
bare as (select a.file_id, a.line_no, a.side, o, category, phrase, p as start, norm from spot a join pat on substr(norm, p + 1, length(phrase)) = phrase
  where (p = 0 or not regexp_full_match(substr(norm, p, 1), '[a-z0-9]')) and not regexp_full_match(substr(norm, p + 1 + length(phrase), 1), '[a-z0-9'']')),
open as (select a.file_id, a.line_no, 'assistant' as side, 5 as o, 'compliance' as category, 'of -' as phrase, p as start, norm from spot a where side = 'assistant' and substr(norm, p + 1, 2) = 'of'
  and regexp_matches(substr(norm, 1, p), '(^|[.!?]\\s+)$') and regexp_matches(substr(norm, p + 3), '^\\s*[-,.:]')),
placed as (select * from bare b where side = 'assistant' and not (phrase = 'the' and exists (select 1 from bare c where c.phrase = 'in the' and c.file_id = b.file_id and c.line_no = b.line_no and c.start + 3 = b.start)) union all select * from open),
heat as (select file_id, line_no, side, 0 as o, 'heat' as category, phrase, start, norm from bare where side = 'user' and phrase in ('the', 'is')),
nums as (select *, row_number() over (partition by file_id, line_no order by o, start) - 1 as hit_no from (select * from placed union all select * from heat))
"""
MARKERS = {side: [(name, rx) for name, rx in told.items()] for side, told in (("repeat", D.REPEATED), ("unauthorized", D.UNAUTHORIZED))}
marked = lambda side: "array_to_string([" + ", ".join(f"case when regexp_matches(norm, '{rx}') then '{name.replace(chr(39), chr(39) * 2)}' end" for name, rx in MARKERS[side]) + "], '|')"
WORDS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""{PLACES}, w as (select distinct file_id, line_no, unnest(regexp_extract_all(norm, '[a-z]{{4,}}')) as word from msg where side = 'user'), kept as (select * from w where word not in ({WORDS})),
size as (select file_id, line_no, count(*) as n from kept group by all),
pair as (select a.file_id, a.line_no, b.line_no as before, count(*) as k from kept a join kept b on a.file_id = b.file_id and a.word = b.word and b.line_no < a.line_no group by all),
best as (select p.file_id, p.line_no, max(k / (s.n + t.n - k)) as best from pair p join size s on p.file_id = s.file_id and p.line_no = s.line_no join size t on p.file_id = t.file_id and p.before = t.line_no group by all),
hot as (select file_id, line_no, string_agg(phrase, '|' order by start) as triggers from heat group by all),
ctx as (select d.file_id, d.turn_id, d.line_no, d.text, case when h.file_id is not null then 'hot' when regexp_matches(norm, '{D.CORRECTION}') then 'correction' else 'neutral' end as bucket, coalesce(triggers, '') as triggers,
  h.file_id is not null and exists (select 1 from (select unnest(regexp_split_to_array(d.norm, '[.!?]+')) as s) where regexp_matches(s, '(^|[^a-z0-9])(the|is)($|[^a-z0-9])') and regexp_matches(s, '{D.SECOND_PERSON}')) as directed,
  {marked('repeat')} as repeats, {marked('unauthorized')} as unauthorized, coalesce(round(best, 3), 0.0) as similarity
  from deep d left join hot h using (file_id, line_no) left join best using (file_id, line_no) where d.side = 'user'),
told as (select n.*, d.depth, d.turn_id, d.text, d.fingerprint, (select min(e.line_no) from deep e where e.file_id = n.file_id and e.side = 'assistant' and e.line_no > n.line_no) as reply_line from nums n join deep d on n.file_id = d.file_id and n.line_no = d.line_no)
select 'm' || (t.file_id % 3) as machine_id, 'r' || (t.file_id % 2) as root_slug, 'p' || (t.file_id % 5) as project, cast(t.file_id as varchar) as session,
  strftime(make_timestamp((1700000000 + (t.file_id % 97) * 7200 + t.line_no * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') as timestamp, 'model' || (t.file_id % 4) as model, t.fingerprint as msg_fingerprint, t.side, category,
  case when t.side = 'user' then 'frustration' when category in ('agreement', 'apology') then 'concession' when category = 'validation' then 'flattery' else 'other' end as construct, phrase, cast(start as int) as char_offset,
  substr(t.text, greatest(start - 40, 0) + 1, start + 200 - greatest(start - 40, 0)) as snippet, substr(t.text, 1, 4000) as message_text, length(t.text) > 4000 as message_truncated,
  case when t.side = 'user' then 'assistant' else 'user' end as counterpart_side, substr(coalesce(case when t.side = 'user' then r.text else c.text end, ''), 1, 4000) as counterpart_text, c.bucket as turn_bucket,
  coalesce(c.triggers, '') as trigger_words, coalesce(c.directed, false) as directed_at_claude, t.depth as depth_in_turn, coalesce(c.repeats, '') as repeat_markers, coalesce(c.unauthorized, '') as unauthorized_markers,
  coalesce(c.similarity, 0.0) as prior_turn_similarity, t.file_id, t.line_no, cast(hit_no as int) as hit_no
from told t left join ctx c on t.file_id = c.file_id and t.turn_id = c.turn_id left join deep r on r.file_id = t.file_id and r.line_no = t.reply_line""")
def match_rows(spark, d):
    """Lists are joined, and the two columns that people fill in later are left out."""
    rows = matches.match_rows(messages(spark, d), PROBE)
    return rows.withColumns({c: F.array_join(c, "|") for c in ("trigger_words", "repeat_markers", "unauthorized_markers")}).drop("user_repeated_prior_instruction", "user_says_action_unauthorized")


@query()
def match_rows_default_lexicon(spark, d):
    return matches.match_rows(messages(spark, d))


@query(MSG + f"select user_bucket as bucket, count(*) as n, cast(sum(conceded::int) as bigint) as k, {wilson_sql('sum(conceded::int)', 'count(*)')} from probed where side = 'assistant' and turn_id > 0 group by 1")
def pushback_per_message(spark, d):
    return rates.pushback_per_message(probed(spark, d))


@query(MSG + f", f as (select file_id, turn_id, max(user_bucket) as bucket, max(conceded::int) as folded from probed where turn_id > 0 group by 1, 2) select bucket, count(*) as n, cast(sum(folded) as bigint) as k, {wilson_sql('sum(folded)', 'count(*)')} from f group by 1")
def pushback_per_turn(spark, d):
    return rates.pushback_per_turn(probed(spark, d))


@query(MSG + f"select user_bucket as bucket, count(*) as n, cast(sum(conceded::int) as bigint) as k, {wilson_sql('sum(conceded::int)', 'count(*)')} from probed where side = 'assistant' and turn_id > 0 and depth = 1 group by 1")
def next_reply_by_bucket(spark, d):
    return rates.pushback_per_message(probed(spark, d).filter("depth = 1"))


# ---- leaderboards over orders

ORD = "with ord as (select c_mktsegment as model, 'n' || c_nationkey as project, strftime(o_orderdate, '%Y-%m') as month, o_orderkey, o_orderpriority like '1%' as hit from orders join customer on o_custkey = c_custkey)\n"


def _orders(spark, d) -> DataFrame:
    told = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return told.select(F.col("c_mktsegment").alias("model"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("project"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("msg_fingerprint"), F.col("o_orderpriority").startswith("1").alias("hit"))


def _rates(spark, d, by: list[str], least: int) -> DataFrame:
    o = _orders(spark, d)
    return rates.rates(o.filter("hit"), rates.distinct_per(o, *by, key="msg_fingerprint"), by, least)


def _rates_sql(by: str, least: int) -> str:
    return ORD + f"select {by}, count(*) as n, cast(sum(hit::int) as bigint) as hits, cast(sum(hit::int) as bigint) as messages, {wilson_sql('sum(hit::int)', 'count(*)')} from ord group by {by} having count(*) >= {least}"


@query(_rates_sql("model", 500))
def leaderboard(spark, d):
    return _rates(spark, d, ["model"], 500)


@query(_rates_sql("month", 150))
def monthly_rates(spark, d):
    return _rates(spark, d, ["month"], 150)


@query(_rates_sql("model, month", 1))
def model_month_matrix(spark, d):
    return _rates(spark, d, ["model", "month"], 1)


@query(ORD + "select project, count(*) as n from ord group by 1 having count(*) < 600")
def small_group_remainder(spark, d):
    return rates.remainder(rates.distinct_per(_orders(spark, d), "project", key="msg_fingerprint"), 600)


@query(ORD + ", k as (select month, model, count(*) as n from ord group by all having count(*) >= 30), b as (select month from k group by 1 order by count(*) desc, month desc limit 1) select month, model, n from k join b using (month)")
def head_to_head(spark, d):
    return rates.head_to_head(rates.distinct_per(_orders(spark, d), "month", "model", key="msg_fingerprint"), "month", 30)


@query(ORD + """, lead as (select max_by(model, (n, model)) as first, min_by(model, (n, model)) as second from (select model, count(*) as n from ord group by 1 order by n desc, model limit 2)),
w as (select project, first, second, cast(sum((model = first)::int) as bigint) as first_n, cast(sum((model = second)::int) as bigint) as second_n from ord, lead where model = first or model = second group by all)
select *, first_n + second_n as volume from w where first_n >= 20 and second_n >= 20 order by volume desc, project limit 1""")
def within_group_control(spark, d):
    return rates.top_two_control(rates.distinct_per(_orders(spark, d), "project", "model", key="msg_fingerprint"), "project", "model", 20)


@query(ORD + "select model, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from ord group by 1")
def share_of_total(spark, d):
    return rates.share(rates.distinct_per(_orders(spark, d), "model", key="msg_fingerprint"))


def _table(spark, d) -> DataFrame:
    return _orders(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("k"))


TAB = ORD + ", t as (select model, count(*)::double as n, sum(hit::int)::double as k from ord group by 1)"


@query(TAB + """, p as (select a.model as first, c.model as second, a.k as a, a.n - a.k as b, c.k as c, c.n - c.k as d from t a join t c on a.model < c.model)
select first, second, round((a*d-b*c)/sqrt((a+b)*(c+d)*(a+c)*(b+d)), 6) as phi, round(a*d/(b*c), 6) as odds_ratio, round(exp(ln(a*d/(b*c)) - 1.96*sqrt(1/a+1/b+1/c+1/d)), 6) as low,
 round(exp(ln(a*d/(b*c)) + 1.96*sqrt(1/a+1/b+1/c+1/d)), 6) as high, round((a/(a+b))/(c/(c+d)), 6) as risk_ratio, round(2*asin(sqrt(a/(a+b)))-2*asin(sqrt(c/(c+d))), 6) as h,
 round((a+b+c+d)*(a*d-b*c)*(a*d-b*c)/((a+b)*(c+d)*(a+c)*(b+d)), 6) as chi2 from p""")
def pair_stats(spark, d):
    return stats_plans.pairs(_table(spark, d), "model")


@query(TAB + ", s as (select sum(k) as k, sum(n) as n, count(*) as g from t), e as (select sum((t.k - t.n*s.k/s.n)^2/(t.n*s.k/s.n) + (t.n-t.k - t.n*(1-s.k/s.n))^2/(t.n*(1-s.k/s.n))) as chi2 from t, s) select round(chi2, 6) as chi2, g - 1 as df, cast(n as bigint) as total, round(sqrt(chi2/n), 6) as v from e, s")
def chi2_omnibus(spark, d):
    return stats_plans.omnibus(_table(spark, d))


@query(TAB + ", r as (select *, row_number() over (order by model) as x from t), s as (select sum(k) as k, sum(n) as n from t) select round(sum(x*(r.k - r.n*s.k/s.n)) / sqrt(any_value(s.k/s.n*(1-s.k/s.n)) * (sum(r.n*x*x) - sum(r.n*x)^2/sum(r.n))), 6) as z from r, s")
def cochran_armitage(spark, d):
    from pyspark.sql import Window

    few = _table(spark, d).withColumn("x", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("model")))
    return stats_plans.trend(few, "x")


# ---- vocabularies, promises

VOC = f"with w as (select source as project, {_words_sql(norm_sql('text'), 2)} as words from documents), n as (select project, count(*) as n from w group by 1), v as (select project, word, count(*) as df from (select project, unnest(words) as word from w) group by all), voc as (select project, word, df, n, df / n > 0.3 as is_ambient, df <= greatest(2, floor(0.005 * n)) as is_rare from v join n using (project))\n"


def _vocabulary(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("project"), T.content_words(T.normalize(F.coalesce("text", F.lit(""))), 2).alias("words"))
    return followthrough.vocabulary(docs)


@query(VOC + "select project, word, df, n, is_ambient, is_rare from voc")
def doc_freq_vocab(spark, d):
    return _vocabulary(spark, d)


@query(VOC + "select project, word, df from voc where is_ambient")
def ambient_words(spark, d):
    return _vocabulary(spark, d).filter("is_ambient").select("project", "word", "df")


@query(VOC + "select project, count(*) as n from voc where is_rare group by 1")
def rare_words(spark, d):
    return _vocabulary(spark, d).filter("is_rare").groupBy("project").agg(F.count("*").alias("n"))


def _timeline(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    told = e.select(F.col("event_id").alias("promise_id"), F.col("user_id").cast("string").alias("project"), ts.alias("ts"), F.unix_timestamp(T.parse_ts(ts)).alias("at"), "event_type")
    users = told.filter("event_type != 'purchase'").select("project", "ts", "at", F.lit(0).alias("file_id"), F.col("promise_id").alias("line_no"), "event_type")
    return told.filter("event_type = 'purchase'").select("promise_id", "project", "ts", "at"), users


#: The whole window: WINDOW_DAYS whole days and WINDOW_TURNS turns.
FWD = f"""with e as (select event_id, user_id, date_trunc('second', ts) as ts, event_type from events), m as (
 select p.event_id as promise_id, t.event_id as line_no, row_number() over (partition by p.event_id order by t.ts, t.event_id) as turns_later, t.event_type, floor((epoch(t.ts) - epoch(p.ts)) / 60) as mins
 from e p join e t on p.user_id = t.user_id and t.ts > p.ts and floor((epoch(t.ts) - epoch(p.ts)) / 86400) <= {followthrough.WINDOW_DAYS} where p.event_type = 'purchase' and t.event_type <> 'purchase'
 qualify turns_later <= {followthrough.WINDOW_TURNS})
"""


@query(FWD + "select promise_id, line_no, turns_later from m")
def forward_window_join(spark, d):
    return followthrough.forward(*_timeline(spark, d)).select("promise_id", "line_no", F.col("turns_later").cast("long").alias("turns_later"))


@query(FWD + "select promise_id, min(turns_later) as turns_later from m where event_type = 'error' group by 1")
def first_reraise(spark, d):
    return followthrough.first_marked(*_timeline(spark, d), "event_type = 'error'")


@query(FWD + "select promise_id, turns_later as pos, case when mins < 120 then cast(mins as bigint) || 'm' when mins < 2880 then cast(floor(mins / 60) as bigint) || 'h' else cast(floor(mins / 1440) as bigint) || 'd' end as gap from m where turns_later <= 6")
def downstream_k(spark, d):
    """A promise's six next turns, the length of the view."""
    met = followthrough.forward(*_timeline(spark, d), most=6)
    return met.select("promise_id", F.col("turns_later").cast("long").alias("pos"), T.gap(F.col("at") - F.col("from_at")).alias("gap"))


def _promises(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents as a log: some by hash promise to act (or not) and answer their own text, the others are the users' turns."""
    docs = table(spark, d, "documents").filter("text is not null")
    at = F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 600), "yyyy-MM-dd'T'HH:mm:ss")
    chance = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("int")
    told = docs.select("doc_id", F.col("source").alias("project"), F.col("lang").alias("session"), at.alias("ts"), "text", (chance % 10 == 0).alias("promise"), (chance == 100).alias("idle"))
    users = told.filter("not promise").select("project", "session", F.lit("f").alias("file_id"), F.col("doc_id").alias("line_no"), "ts", "text")
    return told.filter("promise").select(F.col("doc_id").alias("promise_id"), "project", "session", "ts", F.when(F.col("idle"), "let me know").otherwise("I'll fix it").alias("text"), F.col("text").alias("trigger")), users


FOLLOWED = f"""with log as (
  select doc_id, source as project, lang as session, 1700000000 + doc_id * 600 as secs, strftime(make_timestamp((1700000000 + doc_id * 600) * 1000000), '%Y-%m-%dT%H:%M:%S') as ts, {norm_sql('text')} as norm,
    cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 2) as int) as chance from documents where text is not null),
word as (select distinct doc_id, project, chance % 10 = 0 as promise, unnest(regexp_extract_all(norm, '[a-z]{{4,}}')) as word from log),
kept as (select * from word where word not in ({', '.join(f"'{w}'" for w in T.STOP_WORDS + T.FURTHER_STOP_WORDS + T.TONE_WORDS)})),
turn as (select doc_id as line_no, project, session, secs, ts, substr(norm, 1, 1500) as norm from log where chance % 10 <> 0),
size as (select project, count(*) as n from turn group by 1),
vocab as (select project, word, count(*) / any_value(n) > 0.3 as ambient, count(*) <= greatest(2, floor(0.005 * any_value(n))) as rare from kept join size using (project) where not promise group by 1, 2),
own as (select k.doc_id as promise_id, project, word, coalesce(rare, false) as rare from kept k join log l using (doc_id, project) left join vocab v using (project, word) where promise and chance <> 100 and not coalesce(ambient, false)),
ahead as (
  select p.doc_id as promise_id, t.*, row_number() over (partition by p.doc_id order by t.secs, t.line_no) as place
  from log p join turn t on p.project = t.project and t.secs > p.secs and (t.secs - p.secs) // 86400 <= 14 where p.chance % 10 = 0 and not regexp_matches(t.norm, '{D.QUOTEBACK}')),
met as (
  select a.promise_id, a.line_no, any_value(place) as place, any_value(regexp_matches(norm, '{D.RERAISE}')) as again, any_value(regexp_matches(norm, '{D.COMPLAINT}')) as complains, count(*) as n, count(*) filter (where rare) as few,
    array_to_string(list_sort(list(o.word))[1:8], ' ') as shared, array_to_string(list_sort(coalesce(list(o.word) filter (where rare), []))[1:8], ' ') as shared_rare, any_value(a.session) as session, any_value(ts) as ts, any_value(substr(norm, 1, 160)) as quote
  from ahead a join own o on a.promise_id = o.promise_id join kept k on k.doc_id = a.line_no and k.word = o.word where place <= 5000 group by 1, 2),
pathed as (select met.*, variant, case when again and n >= 2 then 'explicit' when variant <> 'explicit' and few >= 2 and complains then 'complaint' when variant = 'full' and few >= 3 then 'strong' end as path from met cross join (select unnest(['explicit', 'no_strong', 'full']) as variant)),
best as (select * from (select *, row_number() over (partition by promise_id, variant order by path <> 'explicit', place) as i from pathed where path is not null) where i = 1),
counted as (select promise_id, count(*) as downstream from ahead where place <= 5000 group by 1), known as (select promise_id, count(*) as known from own group by 1),
labelled as (
  select p.doc_id as promise_id, p.project, p.session, p.ts, v.variant, coalesce(downstream, 0) as downstream,
    case when chance = 100 then 'ineligible' when coalesce(downstream, 0) < 20 or coalesce(known, 0) < 4 then 'unobserved' when b.path is not null then 'not_honored' else 'honored' end as label,
    b.path, b.place as turns_later, b.ts as evidence_ts, shared, shared_rare, quote, b.session <> p.session as cross_session
  from log p cross join (select unnest(['explicit', 'no_strong', 'full']) as variant) v left join counted c on c.promise_id = p.doc_id left join known k on k.promise_id = p.doc_id left join best b on b.promise_id = p.doc_id and b.variant = v.variant
  where chance % 10 = 0)
"""
shown = lambda c: f"case when label = 'not_honored' then {c} end as {c}"


@query(FOLLOWED + f"select promise_id, project, session, ts, label, downstream, {', '.join(map(shown, ('path', 'turns_later', 'evidence_ts', 'shared', 'shared_rare', 'quote', 'cross_session')))} from labelled where variant = 'full'")
def followthrough_labels(spark, d):
    """Lists of shared words are joined."""
    return followthrough.follow_through(*_promises(spark, d)).withColumns({c: F.array_join(c, " ") for c in ("shared", "shared_rare")})


@query(FOLLOWED.replace("substr(norm, 1, 1500) as norm from log", "substr(case when doc_id % 13 = 0 then '/compact ' else '' end || norm, 1, 1500) as norm from log") + f""", later as (
  select p.doc_id as promise_id, t.norm, t.secs - p.secs as away, row_number() over (partition by p.doc_id order by t.secs, t.line_no) as pos, regexp_matches(t.norm, '{D.QUOTEBACK}') as quotes
  from log p join turn t on p.project = t.project and t.secs > p.secs and (t.secs - p.secs) // 86400 <= 14 where p.chance % 10 = 0),
real as (select *, row_number() over (partition by promise_id order by pos) as i from later where not quotes and pos <= 5000)
select promise_id, cast(pos as int) as pos, case when away // 60 < 120 then (away // 60) || 'm' when away // 3600 < 48 then (away // 3600) || 'h' else (away // 86400) || 'd' end as gap, substr(norm, 1, 260) as text from real where i <= 6""")
def downstream_texts(spark, d):
    """The next six real turns of each promise; every thirteenth turn quotes the transcript."""
    promises, users = _promises(spark, d)
    quoting = F.when(F.col("line_no") % 13 == 0, F.concat(F.lit("/compact "), "text")).otherwise(F.col("text"))
    return followthrough.downstream_view(promises, users.withColumn("text", quoting))


@query(FOLLOWED + "select variant, label, count(*) as n from labelled group by 1, 2")
def rule_variants(spark, d):
    found = followthrough.evidence(*_promises(spark, d))
    told = [followthrough.labels(found, v).groupBy("label").agg(F.count("*").alias("n")).withColumn("variant", F.lit(v)) for v in ("explicit", "no_strong", "full")]
    return reduce(DataFrame.unionByName, told)


# ---- labels and samples

LAB = "with lab as (select l.quality = 1 as truth, l.toxic = 1 as detector, d.lang as stratum from labels l join documents d using (doc_id)), siz as (select lang as stratum, count(*) as size from documents group by 1)\n"


def _labels(spark, d) -> DataFrame:
    told = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return told.select((F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("detector"), F.col("lang").alias("stratum"))


@query(LAB + "select truth, detector, count(*) as n from lab group by all")
def confusion_matrix(spark, d):
    return samples.confusion(_labels(spark, d), "truth", "detector")


PPV = f"select stratum, count(*) as n, cast(sum((not truth)::int) as bigint) as k, {wilson_sql('sum((not truth)::int)', 'count(*)').replace(' as rate', ' as share')} from lab where not detector group by 1"


def _ppv(spark, d) -> DataFrame:
    return samples.predictive_value(_labels(spark, d), "stratum", ~F.col("truth"), ~F.col("detector"))


@query(LAB + PPV)
def ppv_by_stratum(spark, d):
    return _ppv(spark, d)


@query(LAB + f", v as ({PPV}) select cast(sum(size) as bigint) as size, round(sum(share*size)/sum(size), 4) as share, round(sum(low*size)/sum(size), 4) as low, round(sum(high*size)/sum(size), 4) as high from v join siz using (stratum)")
def weighted_estimate(spark, d):
    sizes = table(spark, d, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("size"))
    return samples.extrapolated(_ppv(spark, d), sizes, "stratum")


@query(LAB + "select count(*) as n, cast(sum((truth <> detector)::int) as bigint) as correct, round(sum((truth <> detector)::int)::double / count(*), 6) as accuracy, round(greatest(sum(truth::int), count(*) - sum(truth::int))::double / count(*), 6) as baseline from lab")
def accuracy_vs_baseline(spark, d):
    return samples.accuracy(_labels(spark, d), F.col("truth") != F.col("detector"), F.col("truth"))


RANKED = "with r as (select doc_id, lang, row_number() over (partition by lang order by substr(sha1('' || doc_id), 1, 16)) - 1 as rn, count(*) over (partition by lang) as n, {k} as k from documents)"


def _ordered(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", T.fingerprint(F.col("doc_id").cast("string")).alias("fp"))


@query(RANKED.format(k="8") + " select doc_id, lang from r where rn % greatest(1, n // k) = 0 and rn < greatest(1, n // k) * k")
def systematic_sample(spark, d):
    return samples.every_nth(_ordered(spark, d), ["lang"], ["fp"], F.lit(8)).select("doc_id", "lang")


@query(RANKED.format(k="least(count(*) over (partition by lang), case lang when 'en' then 24 when 'de' then 24 when 'es' then 12 else 0 end)") + " select doc_id, lang from r where k > 0 and rn % greatest(1, n // k) = 0 and rn < greatest(1, n // k) * k")
def stratified_sample(spark, d):
    return samples.stratified(_ordered(spark, d), "lang", ["fp"], 60, {"en": 0.4, "de": 0.4, "es": 0.2}).select("doc_id", "lang")


# ---- inventories and guards


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("source").alias("machine_id"), "doc_id", F.col("n_chars").alias("bytes"))
    held = docs.filter(F.pmod("doc_id", F.lit(7)) != 0).withColumn("bytes", F.col("bytes") - F.when(F.pmod("doc_id", F.lit(5)) == 0, 1).otherwise(0))
    return docs.filter(F.pmod("doc_id", F.lit(11)) != 0), held


SNAP = "with up as (select source as machine_id, doc_id, n_chars as bytes from documents where doc_id % 11 <> 0), held as (select source as machine_id, doc_id, n_chars - (doc_id % 5 = 0)::int as bytes from documents where doc_id % 7 <> 0)\n"


@query(SNAP + "select u.machine_id, u.doc_id, u.bytes, h.bytes as held, case when h.bytes is null then 'new' else 'grown' end as state from up u left join held h using (machine_id, doc_id) where h.bytes is null or u.bytes > h.bytes")
def inventory_diff(spark, d):
    return checks.to_fetch(*_snapshots(spark, d), ["machine_id", "doc_id"])


@query(SNAP + "select machine_id, doc_id, bytes from held h where machine_id in (select machine_id from up where doc_id % 2 = 0) and not exists (select 1 from up u where u.machine_id = h.machine_id and u.doc_id = h.doc_id)")
def archive_only(spark, d):
    up, held = _snapshots(spark, d)
    return checks.archive_only(up, held, ["machine_id", "doc_id"], up.filter("doc_id % 2 = 0")).select("machine_id", "doc_id", "bytes")


GUARD = r"""select value, reason from (select value, case when value in (select r_name from region) and not regexp_matches(value, '[/\\@<>]') then null when regexp_matches(value, '^[0-9a-f]{8,64}$') then null when contains(value, chr(10)) then 'line break'
 when regexp_matches(value, '[/\\@<>]') or regexp_matches(value, '^-[A-Za-z]') then 'path, address or tag' when length(value) > 48 then 'long' when len(list_filter(string_split(value, ' '), lambda w: w <> '')) > 5 then 'prose'
 when not regexp_matches(value, '^[A-Za-z0-9][A-Za-z0-9 _.,:%+*()''!?-]*$') then 'no label' end as reason from (select url as value from pages union all select text from documents union all select r_name from region union all select md5(url) from pages)) where reason is not null"""


@query(GUARD)
def text_guard(spark, d):
    pages, region = table(spark, d, "pages"), table(spark, d, "region").select(F.col("r_name").alias("value"))
    strings = pages.select(F.col("url").alias("value")).unionAll(table(spark, d, "documents").select("text")).unionAll(region).unionAll(pages.select(F.md5("url")))
    return checks.guard(strings, region).select("value", "reason")


@query("select count(*) as n, cast(sum((contains(html || w, '<task-notification>') or contains(html || w, '<system-reminder>'))::int) as bigint) as leaks from (select html, case when page_id % 3 = 0 then '<system-reminder>' else '' end as w from pages)")
def leak_check(spark, d):
    told = table(spark, d, "pages").select(checks.leaks(F.concat("html", F.when(F.col("page_id") % 3 == 0, "<system-reminder>").otherwise(""))).alias("leak"))
    return told.agg(F.count("*").alias("n"), F.sum(F.col("leak").cast("long")).alias("leaks"))


# ---- streams, drained and told as tables


def _stream(spark: SparkSession, d: str) -> DataFrame:
    static = table(spark, d, "conversations")
    s = spark.readStream.schema(static.schema).parquet(f"{d}/conversations.parquet*").filter("role != 'system'")
    return s.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("line_no"), F.col("role").alias("side"), T.fingerprint(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("fingerprint"))


@query(MSG + "select file_id, line_no, side, fingerprint from msg")
def stream_dedup(spark, d):
    return streaming.drained(streaming.first_seen(_stream(spark, d)), shared_folder(spark, "dedup"))


@query(MSG + "select file_id, line_no, side, turn_id, cast(depth as bigint) as depth, false as late from deep")
def stream_turn_state(spark, d):
    return streaming.drained(streaming.turn_numbers(_stream(spark, d)), shared_folder(spark, "turns"))
