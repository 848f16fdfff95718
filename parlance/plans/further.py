"""Further registered queries: constructs, promises, calibration, exports, verification. Registered beside those of queries.py."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import dictionary as D
from parlance.functions import table_function
from parlance.functions import text as T
from parlance.functions.lexicon import Lexicon
from parlance.operators import audits, calibration, checks, constructs, matches, turns, verification
from parlance.plans import stats_plans
from parlance.plans.queries import HITS, MSG, PLACES, PROBE, QUERIES, SQL, _hits, count_sql, messages, query, table, wilson_sql
from parlance.streaming import conversations as streaming
from parlance.streaming import stateful
from parlance.streaming.ordered import stateful_session
from parlance.sources.scratch import shared_folder

__all__ = ["QUERIES", "SQL"]

CONSTRUCT = "case when category in ('agreement', 'apology') then 'concession' else 'flattery' end"


def _rows(spark, d) -> DataFrame:
    """The probe's hits as match rows: with model, construct and the turn's bucket."""
    told = _hits(spark, d).withColumnRenamed("user_bucket", "turn_bucket")
    return told.withColumns({"construct": PROBE.construct(F.col("category")), "model": F.concat(F.lit("model"), F.pmod("file_id", F.lit(4)).cast("string"))})


def _heat(spark, d) -> DataFrame:
    """The probe's heated words of user messages as match rows."""
    users = messages(spark, d).filter("side = 'user'").withColumn("norm", T.normalize(F.col("text")))
    told = users.select("side", F.col("fingerprint").alias("msg_fingerprint"), "session", F.col("ts").alias("timestamp"), F.explode(PROBE.heat_hits("norm")).alias("h"))
    return told.select("side", "msg_fingerprint", "session", "timestamp", "h.category", "h.phrase", (F.col("h.phrase") == "is").alias("directed_at_claude"))


HEAT = MSG + f""", heat as (select fingerprint, file_id, unnest([struct_pack(word := 'the', n := {count_sql('the')}), struct_pack(word := 'is', n := {count_sql('is')})], recursive := true) from msg where side = 'user'),
heated as (select * from heat where n > 0)
"""


@query(HITS + f""", c as (select {CONSTRUCT} as construct, cast(sum(n) as bigint) as hits, count(distinct fingerprint) as messages from hits group by 1), p as (select count(distinct fingerprint) as n from msg where side = 'assistant')
select construct, 'assistant' as side, hits, messages, n, {wilson_sql('messages', 'n')} from c, p""")
def construct_rates(spark, d):
    return constructs.construct_rates(_rows(spark, d), messages(spark, d))


@query(HITS + f""", p as (select 'model' || (file_id % 4) as model, count(distinct fingerprint) as n from msg where side = 'assistant' group by 1 having count(distinct fingerprint) >= 50),
c as (select 'model' || (file_id % 4) as model, {CONSTRUCT} as construct, sum(n) as hits, count(distinct fingerprint) as messages from hits group by 1, 2)
select p.model, n, cast(coalesce(a.hits, 0) as bigint) as concession_hits, coalesce(a.messages, 0) as concession_messages, cast(coalesce(b.hits, 0) as bigint) as flattery_hits, coalesce(b.messages, 0) as flattery_messages,
 {wilson_sql('coalesce(a.messages, 0)', 'n').replace(' as ', ' as concession_')}, {wilson_sql('coalesce(b.messages, 0)', 'n').replace(' as ', ' as flattery_')}
from p left join c a on a.model = p.model and a.construct = 'concession' left join c b on b.model = p.model and b.construct = 'flattery'""")
def model_constructs(spark, d):
    return constructs.model_constructs(_rows(spark, d), messages(spark, d), ["concession", "flattery"], 50)


@query(HEAT + f", p as (select count(distinct fingerprint) as n from msg where side = 'user'), c as (select 'heat' as category, cast(sum(n) as bigint) as hits, count(distinct fingerprint) as messages from heated) select category, hits, messages, n, {wilson_sql('messages', 'n')} from c, p")
def user_categories(spark, d):
    return constructs.user_categories(_heat(spark, d), messages(spark, d))


HEAT_PARTS = " union all ".join(
    f"select '{name}' as dimension, {value} as value, cast(sum(n) as bigint) as hits, count(distinct fingerprint) as messages from heated group by 2"
    for name, value in {"category": "'heat'", "word": "word", "month": "strftime(make_timestamp((1700000000 + (file_id % 97) * 7200) * 1000000), '%Y-%m')", "session": "cast(file_id as varchar)", "aim": "case when word = 'is' then 'directed' else 'ambient' end"}.items()
)


@query(HEAT + HEAT_PARTS)
def heat_counters(spark, d):
    """Months are those of the conversation's first minute, since its turns stay within a day of it in the tables."""
    month = F.date_format(F.timestamp_seconds(1_700_000_000 + F.pmod(F.col("session").cast("long"), F.lit(97)) * 7200), "yyyy-MM-dd'T'HH:mm:ss")
    return constructs.heat_counters(_heat(spark, d).withColumn("timestamp", month))


@query(MSG + f", k as (select {count_sql('in the')} as k from msg where side = 'assistant') select cast(sum(k) as bigint) as occurrences, cast(sum((k > 0)::int) as bigint) as messages, count(*) as n, {wilson_sql('sum((k > 0)::int)', 'count(*)')} from k")
def exact_phrase(spark, d):
    """Messages are met twice; each counts once."""
    told = messages(spark, d).filter("side = 'assistant'")
    again = told.withColumn("file_id", F.col("file_id") + 1_000_000)
    return constructs.phrase_occurrences(told.unionByName(again), r"(?<![a-z0-9])in the(?![a-z0-9'])")


@query(HITS + f", c as (select distinct fingerprint from hits where {CONSTRUCT} = 'concession') select user_bucket as bucket, count(*) as n, count(c.fingerprint) as k from probed left join c using (fingerprint) where side = 'assistant' and turn_id > 0 group by 1")
def concession_stream(spark, d):
    from parlance.plans.queries import probed

    told = constructs.with_conceded(probed(spark, d).drop("conceded").filter("turn_id > 0"), _rows(spark, d))
    return told.filter("side = 'assistant'").groupBy(F.col("user_bucket").alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("conceded").cast("long")).alias("k"))


COMPOSED = HITS + f", c as (select user_bucket as bucket, cast(sum(n) as bigint) as n, cast(sum(case when {CONSTRUCT} = 'concession' then n else 0 end) as bigint) as k from hits where user_bucket is not null group by 1)\n"


@query(COMPOSED + f"select bucket, n, k, {wilson_sql('k', 'n')} from c")
def hit_composition(spark, d):
    return constructs.composition(_rows(spark, d))


@query(COMPOSED + "select round(sum((k - n * p) ** 2 / (n * p) + ((n - k) - n * (1 - p)) ** 2 / (n * (1 - p))), 6) as chi2, count(*) - 1 as df, cast(max(t) as bigint) as total, round(sqrt(sum((k - n * p) ** 2 / (n * p) + ((n - k) - n * (1 - p)) ** 2 / (n * (1 - p))) / max(t)), 6) as v from c, (select sum(k)::double / sum(n) as p, sum(n) as t from c)")
def hit_composition_test(spark, d):
    return stats_plans.omnibus(constructs.composition(_rows(spark, d)))


@query(PLACES + """, c as (select side, phrase, count(*) as n from nums where phrase <> 'of -' group by 1, 2)
select side, phrase, n, rank from (select *, cast(row_number() over (partition by side order by n desc, phrase) as int) as rank from c) where rank <= 3""")
def top_phrases_sides(spark, d):
    said = _rows(spark, d).select("side", "category", "phrase").unionByName(_heat(spark, d).select("side", "category", "phrase"))
    return constructs.top_phrases(constructs.export_tally(said), 3)


COUNTED = HITS + """, m as (select *, 'model' || (file_id % 4) as model, strftime(make_timestamp((1700000000 + (file_id % 97) * 7200 + line_no * 60) * 1000000), '%Y-%m') as month from msg where side = 'assistant'),
h as (select n, category, phrase, m.* from hits join m using (file_id, line_no))
"""
COUNTED += " union all ".join(
    f"select '{d}' as dimension, {v} as value, {m} as messages, {c} as characters, cast(coalesce(hits, 0) as bigint) as hits, coalesce(hit_messages, 0) as hit_messages from {t}"
    for d, v, m, c, t in [
        *((d, f"t.{d}", "messages", "characters", f"(select {d}, count(*) as messages, cast(sum(length(text)) as bigint) as characters from m group by 1) t left join (select {d}, sum(n) as hits, count(distinct fingerprint) as hit_messages from h group by 1) u on t.{d} = u.{d}") for d in ("model", "project", "month")),
        *((d, d, "null", "null", f"(select {d}, sum(n) as hits, count(distinct h.fingerprint) as hit_messages from h group by 1)") for d in ("category", "phrase")),
        ("all", "null", "messages", "characters", "(select count(*) as messages, cast(sum(length(text)) as bigint) as characters from m), (select sum(n) as hits, count(distinct fingerprint) as hit_messages from h)"),
    ]
)


@query(COUNTED)
def scan_counters(spark, d):
    said = messages(spark, d).filter("side = 'assistant'")
    hits = said.withColumn("norm", T.normalize(F.col("text"))).select("model", "project", "ts", "fingerprint", F.explode(PROBE.phrase_hits("norm")).alias("h"))
    return audits.scan_counters(said, hits.select("model", "project", "ts", "fingerprint", "h.category", "h.phrase"), ("model", "project", "month", "category", "phrase", "all"))


# ---- audits

PLACED = PLACES + ", spoken as (select file_id, line_no, phrase, start, norm from bare where side = 'assistant' and phrase in ('in the', 'that', 'to', 'is'))"


def _placed(spark, d) -> DataFrame:
    said = messages(spark, d).filter("side = 'assistant'").withColumn("norm", T.normalize(F.col("text")))
    told = said.select("file_id", "line_no", "norm", F.explode(PROBE.phrase_hits("norm")).alias("h")).select("file_id", "line_no", "norm", "h.phrase", F.col("h.start").cast("long").alias("start"))
    return told.filter("phrase != 'the'")


@query(PLACED + """, n as (select phrase, count(*) as n from spoken group by 1 having count(*) <= 400),
ranked as (select s.*, n, row_number() over (partition by phrase order by file_id, line_no, start) as i from spoken s join n using (phrase))
select phrase, n, file_id, line_no, start, substr(norm, greatest(start - 75, 0) + 1, start + 65 - greatest(start - 75, 0)) as context from ranked where (i - 1) % greatest(1, n // 7) = 0 and (i - 1) // greatest(1, n // 7) < 7""")
def precision_audit(spark, d):
    return audits.precision_audit(_placed(spark, d), "norm", 7, most=400)


@query(PLACED + ", once as (select distinct phrase, substr(norm, greatest(start - 20, 0) + 1, 40) as shown from spoken) select phrase, shown from (select *, row_number() over (partition by phrase order by shown) as i from once) where i <= 3")
def phrase_examples(spark, d):
    return audits.examples(_placed(spark, d).select("phrase", F.expr("substring(norm, cast(greatest(start - 20, 0) + 1 as int), 40)").alias("shown")), "phrase", "shown")


@query(MSG + f", c as (select fingerprint, unnest([struct_pack(phrase := 'in the', n := {count_sql('in the')}), struct_pack(phrase := 'of', n := {count_sql('of')})], recursive := true) from msg where side = 'user') select 'control' as category, phrase, cast(sum(n) as bigint) as hits, count(distinct fingerprint) as messages from c where n > 0 group by 2")
def user_control(spark, d):
    return audits.user_control(messages(spark, d), replace(PROBE, user={"control": ["of", "in the"]}))


@query(MSG + f""", s as (select trim(unnest(regexp_split_to_array(norm, '[.!?\\n]+')), ' -*#`>') as sentence from msg)
select substr(sentence, 1, 70) as sentence, count(*) as n from s where length(sentence) between 8 and 200 and regexp_matches(sentence, '{D.NEAR_MISS}|\\b(?:of the|in that)\\b') group by 1""")
def near_misses(spark, d):
    """Sentences that smell of an admission, and, since the tables have few of those, some of plain words."""
    return audits.near_misses(messages(spark, d), pattern=rf"{D.NEAR_MISS}|\b(?:of the|in that)\b")


# ---- promises and calibration

FEW = "substr(sha1((file_id % 50) || ':' || line_no), 1, 16)"


@query(HITS + f""", r as (select {FEW} as promise_id, file_id, line_no, category, phrase, case phrase when 'in the' then 1 when 'that' then 2 else 3 end as o from hits where {CONSTRUCT} = 'concession')
select promise_id, first(file_id) as file_id, first(category) as category, first(phrase) as phrase from (select *, row_number() over (partition by promise_id order by file_id, line_no, o) as i from r) where i = 1 group by promise_id""")
def promises(spark, d):
    """Eligible rows, one a fingerprint; fingerprints repeat in every fiftieth conversation."""
    order = F.when(F.col("phrase") == "in the", 1).when(F.col("phrase") == "that", 2).otherwise(3)
    told = _rows(spark, d).withColumns({"msg_fingerprint": T.fingerprint(F.concat_ws(":", F.pmod("file_id", F.lit(50)).cast("string"), F.col("line_no").cast("string"))), "hit_no": order * 1_000_000 + F.col("start")})
    for c in ("project", "timestamp", "message_text", "counterpart_text"):
        told = told.withColumn(c, F.lit(""))
    once = calibration.promises_of(told.withColumn("session", F.col("file_id")))
    return once.select("promise_id", F.col("session").alias("file_id"), "category", "phrase")


SAID = """with lab as (select doc_id, substr(sha1('' || doc_id), 1, 16) as msg_fingerprint, case when doc_id % 11 = 0 then 'cant_tell' when quality = 1 then 'yes' else 'no' end as did_it from labels),
output as (select substr(sha1('' || doc_id), 1, 16) as msg_fingerprint, case doc_id % 4 when 0 then 'ineligible' when 1 then 'unobserved' when 2 then 'honored' else 'not_honored' end as label, ['explicit', 'complaint', 'strong'][1 + doc_id % 3] as path, doc_id % 2 = 0 as cross_session, doc_id % 97 as turns_later from documents where doc_id % 5 <> 0)
"""


def _said(spark, d) -> DataFrame:
    key = T.fingerprint(F.col("doc_id").cast("string")).alias("msg_fingerprint")
    return table(spark, d, "labels").select("doc_id", key, F.when(F.col("doc_id") % 11 == 0, "cant_tell").when(F.col("quality") == 1, "yes").otherwise("no").alias("did_it"))


def _output(spark, d) -> DataFrame:
    key = T.fingerprint(F.col("doc_id").cast("string")).alias("msg_fingerprint")
    told = table(spark, d, "documents").filter("doc_id % 5 != 0")
    label = F.element_at(F.array(*map(F.lit, ("ineligible", "unobserved", "honored", "not_honored"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.element_at(F.array(*map(F.lit, ("explicit", "complaint", "strong"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return told.select(key, label.alias("label"), path.alias("path"), (F.col("doc_id") % 2 == 0).alias("cross_session"), (F.col("doc_id") % 97).alias("turns_later"))


@query(SAID + "select l.doc_id, did_it, case did_it when 'yes' then 'honored' when 'no' then 'not_honored' end as truth, o.label as now from lab l left join output o using (msg_fingerprint)")
def calibration_join(spark, d):
    return calibration.with_output(_said(spark, d), _output(spark, d)).select("doc_id", "did_it", "truth", "now")


@query(SAID + "select doc_id from lab anti join output using (msg_fingerprint)")
def calibration_unmatched(spark, d):
    return calibration.unmatched(_said(spark, d), _output(spark, d)).select("doc_id")


@query(SAID + "select doc_id, did_it, label from lab join output using (msg_fingerprint) where did_it in ('yes', 'no')")
def hand_labels(spark, d):
    return calibration.hand_checked(_said(spark, d), _output(spark, d), "did_it").select("doc_id", "did_it", "label")


@query(SAID + "select o.msg_fingerprint, o.label, case when did_it in ('yes', 'no') then did_it end as did_it from output o left join lab using (msg_fingerprint) where turns_later < 10")
def prefill(spark, d):
    return calibration.prefilled(_output(spark, d).filter("turns_later < 10").select("msg_fingerprint", "label"), _said(spark, d))


@query(SAID + """select 'label' as what, label as value, count(*) as n from output group by 2 union all select 'path', path, count(*) from output where label = 'not_honored' group by 2
union all select 'cross_session', 'true', count(*) filter (where cross_session) from output where label = 'not_honored'
union all select 'median_turns_later', '', list_sort(list(turns_later))[count(*) // 2 + 1] from output where label = 'not_honored'""")
def label_mix(spark, d):
    return calibration.label_mix(_output(spark, d))


# ---- exports


@query(HITS + "select 'assistant' as side, category, phrase, cast(sum(n) as bigint) as n from hits group by 2, 3")
def export_tally(spark, d):
    return constructs.export_tally(_hits(spark, d))


@query("select event_id, strftime(ts, '%Y-%m') as ts, substr(sha256(event_type), 1, 12) as event_type from events")
def export_coarsened(spark, d):
    told = table(spark, d, "events").select("event_id", "ts", "event_type", F.lit("prose").alias("note"))
    return constructs.coarsened(told, ["ts"], ["note"], ["event_type"])


@query("""select o_orderkey, (year(b) - year(a)) * 12 + month(b) - month(a) - (day(b) < day(a))::int as months, case month(a) when 2 then 28 when 4 then 30 when 6 then 30 when 9 then 30 when 11 then 30 else 31 end as days,
 replace(o_orderpriority, '1-', '') as short, substr(sha256(o_orderpriority), 1, 8) as machine from (select *, cast(o_orderdate as date) as a, cast(o_orderdate as date) + (o_orderkey % 200)::int as b from orders)""")
def dates_and_names(spark, d):
    a = F.col("o_orderdate").cast("date")
    b = F.date_add(a, F.pmod("o_orderkey", F.lit(200)).cast("int"))
    said = lambda c: c.cast("string")
    return table(spark, d, "orders").select("o_orderkey", T.month_span(said(a), said(b)).cast("long").alias("months"), T.days_in_month(F.substring(said(a), 1, 7)).alias("days"), T.short_model(F.col("o_orderpriority"), "1-").alias("short"), T.machine_id(F.col("o_orderpriority")).alias("machine"))


@query("with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by 1) select month, n, lag(n) over (order by month) as before, n > lag(n) over (order by month) as rose from m")
def month_over_month(spark, d):
    series = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return constructs.compared_months(series, "n")


# ---- verification


def _checked(spark, d) -> DataFrame:
    """The dataset of hits, of which every hundredth conversation's rows are missing, against a live count of all."""
    live, base = _hits(spark, d), messages(spark, d)
    files = base.select("file_id").distinct()
    return verification.dataset_checks(live.filter("file_id % 100 != 7"), live, base, files.filter("file_id % 100 != 8"), files, ["side", "phrase", "model"])


@query(HITS + """, a as (select cast(sum(n) filter (where file_id % 100 <> 7) as bigint) as a, cast(sum(n) as bigint) as b from hits), f as (select count(distinct file_id) filter (where file_id % 100 <> 8) as a, count(distinct file_id) as b from msg)
select 'rows equal a live count, both sides' as name, a = b as holds, case when a = b then '' else '1 groups differ: ' || a || ' and ' || b end as detail from a
union all select 'files equal those found', a = b, case when a = b then '' else '1 groups differ: ' || a || ' and ' || b end from f
union all select 'all columns are there', false, 'model' union all select 'every row has a fingerprint', true, '0'
union all select 'both sides have a denominator', count(distinct side) = 2, '' || count(distinct side) from msg
union all select 'no injected markup is left', count(*) = 0, '' || count(*) from msg where contains(text, '<task-notification>') or contains(text, '<system-reminder>')""")
def dataset_checks(spark, d):
    return _checked(spark, d)


@query(HITS + """, t as (select cast(sum(n) as bigint) as n from hits), m as (select count(*) as n from msg), f as (select count(distinct file_id) as n from msg)
select 'the tally''s total is the dataset''s' as name, true as holds, n || ' and ' || n as detail from t union all select 'the stated counts are the tables''', false, f.n || ' and ' || f.n || ' and ' || (m.n + 1) || ' and ' || m.n from f, m""")
def freshness(spark, d):
    hits, base = _hits(spark, d), messages(spark, d)
    files = base.select("file_id").distinct()
    stated = files.agg(F.count("*").alias("files")).crossJoin(F.broadcast(base.agg((F.count("*") + 1).alias("messages"))))
    return verification.freshness(constructs.export_tally(hits), hits, stated, files, base)


@query(COMPOSED + """, f as (select max(case when bucket = 'hot' then k::double / n end) as hot, max(case when bucket = 'neutral' then k::double / n end) as neutral, sum(n) as n from c)
select 'hot turns concede more' as name, coalesce(hot > neutral, false) as holds, '' as detail from f union all select 'over ten hits', n > 10, '' from f union all select 'can''t be told', false, ''""")
def claims(spark, d):
    told = constructs.composition(_rows(spark, d))
    share = lambda b: F.max(F.when(F.col("bucket") == b, F.col("k") / F.col("n")))
    facts = told.agg(share("hot").alias("hot"), share("neutral").alias("neutral"), F.sum("n").alias("n"), F.lit(None).cast("double").alias("gone"))
    return verification.claims(facts, {"hot turns concede more": "hot > neutral", "over ten hits": "n > 10", "can't be told": "gone > 1"})


@query("select machine_id, root from (select distinct source as machine_id, lang as root from documents) where not (root = 'en' and machine_id in (select source from documents where doc_id % 2 = 0))")
def roots_not_configured(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("machine_id"), F.col("lang").alias("root"), "doc_id")
    return checks.not_configured(docs, docs.filter("root = 'en' and doc_id % 2 = 0"))


@query("select conv_id as file_id from conversations group by 1 having count(*) filter (where role = 'user' and turn % 3 = 0) > 0")
def files_with_population(spark, d):
    files = table(spark, d, "conversations").select(F.col("conv_id").alias("file_id")).distinct()
    return turns.files_of(files, messages(spark, d).filter("side = 'user' and line_no % 3 = 0"))


@query(MSG + "select file_id, line_no, side, fingerprint from msg")
def stream_dedup_repeats(spark, d):
    """Every message arrives twice; the stream keeps one of each."""
    static = table(spark, d, "conversations")
    s = spark.readStream.schema(static.schema).parquet(f"{d}/conversations.parquet*").filter("role != 'system'").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    s = s.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("line_no"), F.col("role").alias("side"), T.fingerprint(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("fingerprint"))
    return streaming.drained(streaming.first_seen(s), shared_folder(spark, "dedup"))


def _landed(spark, rows: DataFrame, name: str, ends: bool = False) -> DataFrame:
    """``rows`` (file_id, line_no, side, at and more) as a stream; a last row of each file says that it is over, and one far ahead moves the watermark."""
    own, folder = stateful_session(spark), shared_folder(spark, name)
    blank = {c: F.lit(None).cast(t) for c, t in rows.dtypes}
    last = rows.groupBy("file_id").agg((F.max("line_no") + 1).alias("line_no"), (F.max("at") + F.expr("interval 1 minute")).alias("at")).withColumn("side", F.lit("end"))
    beat = rows.agg(F.lit(-1).cast(dict(rows.dtypes)["file_id"]).alias("file_id"), F.lit(0).cast("long").alias("line_no"), (F.max("at") + F.expr("interval 1 year")).alias("at")).withColumn("side", F.lit("assistant"))
    filled = lambda df: df.select(*[F.col(c) if c in df.columns else blank[c].alias(c) for c in rows.columns])
    every = rows.unionByName(filled(last)).unionByName(filled(beat)) if ends else rows.unionByName(filled(beat))
    every.write.parquet(f"{folder}/in")
    return own.readStream.schema(every.schema).parquet(f"{folder}/in")


def _timed(told: DataFrame) -> DataFrame:
    return told.withColumns({"line_no": F.col("line_no").cast("long"), "at": F.to_timestamp("ts")})


@query(MSG + ", r as (select *, row_number() over (partition by file_id order by line_no desc) as back from probed) select file_id, turn_id, max(user_bucket) as bucket, count(*) filter (where side = 'assistant') as replies, coalesce(bool_or(conceded), false) as folded from r where turn_id > 0 group by 1, 2")
def stream_closed_turns(spark, d):
    """Turns as they close; a last row of each conversation says that it is over."""
    from parlance.plans.queries import probed

    told = _timed(probed(spark, d)).select("file_id", "line_no", "side", "at", "bucket", "conceded")
    out = streaming.drained(stateful.closed_turns(_landed(spark, told, "turns", ends=True), "1 hour"), shared_folder(spark, "closed-turns"))
    return out.filter("late_line is null and file_id >= 0").drop("late_line")


@query(MSG + """, w as (select distinct file_id, line_no, unnest(regexp_extract_all(norm, '[a-z]{4,}')) as word from msg where side = 'user'), kept as (select * from w where word not in (STOP)),
size as (select file_id, line_no, count(*) as n from kept group by all),
pair as (select a.file_id, a.line_no, b.line_no as before, count(*) as k from kept a join kept b on a.file_id = b.file_id and a.word = b.word and b.line_no < a.line_no group by all),
best as (select p.file_id, p.line_no, max(k / (s.n + t.n - k)) as best from pair p join size s on p.file_id = s.file_id and p.line_no = s.line_no join size t on p.file_id = t.file_id and p.before = t.line_no group by all),
usr2 as (select u.file_id, u.turn_id, coalesce(round(best, 3), 0.0) as similarity from deep u left join best using (file_id, line_no) where u.side = 'user')
select p.file_id, p.line_no, p.turn_id, p.depth, p.user_bucket, u.similarity as user_similarity from probed p left join usr2 u using (file_id, turn_id)""".replace("STOP", ", ".join(f"'{w}'" for w in T.STOP_WORDS)))
def stream_carried_context(spark, d):
    """What each message carries of its turn, from state: the bucket by the probe's words, the similarity to all earlier user messages."""
    from parlance.plans.queries import probed

    told = _timed(probed(spark, d)).select("file_id", "line_no", "side", "at", "bucket", F.when(F.col("side") == "user", T.content_words(F.col("norm"))).alias("words"))
    none = F.array().cast("array<string>")
    stream = _landed(spark, told, "messages").withColumns({"triggers": none, "directed": F.lit(False), "repeat_markers": none, "unauthorized_markers": none})
    out = streaming.drained(stateful.carried_context(stream, "1 hour"), shared_folder(spark, "carried"))
    return out.filter("not late and file_id >= 0").select("file_id", "line_no", "turn_id", "depth", "user_bucket", "user_similarity")


@query("select strftime(ts, '%Y-%m') as month, event_type as side, count(*) as n from events group by 1, 2")
def stream_months(spark, d):
    """Events by calendar month and type; one far ahead, of no type, moves the watermark."""
    told = table(spark, d, "events").select(F.col("event_id").alias("file_id"), F.lit(0).cast("long").alias("line_no"), F.col("event_type").alias("side"), F.col("ts").cast("timestamp").alias("at"))
    stream = _landed(spark, told, "events").withColumn("side", F.when(F.col("file_id") >= 0, F.col("side")))
    out = streaming.drained(stateful.monthly(stream, "at"), shared_folder(spark, "months"))
    return out.filter("side is not null")


# ---- the dictionary from SQL


@query(HITS + "select file_id, line_no, phrase, category, cast(n as bigint) as n from hits")
def table_function_hits(spark, d):
    """The table function beside each message, from SQL; the probe's phrases alone."""
    table_function.register(spark, replace(PROBE, openers={}), "probe_rows")
    messages(spark, d).filter("side = 'assistant'").createOrReplaceTempView("probe_messages")
    return spark.sql("select m.file_id, m.line_no, h.phrase, h.category, count(*) as n from probe_messages m, lateral probe_rows(m.text) h group by all")


# ---- the default dictionary on known sentences

# Sentences, and the phrases and offsets the published rules find in them.
SENTENCES = ("You're right. I'll fix the parser.", "Let me look.", "I was wrong about it, my mistake", "Good catch", "I introduced neither; both are pre-existing.", "given that, i will", "Good question, you're right", "my error handling caught it cleanly, no crash",
    "That is a valid objection.", "Right - he is talking", "a fair objection, and you're right")
KNOWN = ((0, "you're right", 0), (2, "i was wrong", 0), (2, "my mistake", 22), (3, "good catch", 0), (6, "good question", 0), (6, "you're right", 15),
    (8, "valid objection", 10), (9, "right -", 0), (10, "you're right", 22), (10, "fair objection", 2))


@query(MSG + f", known(i, phrase, start) as (values {', '.join('(%d, %s, %d)' % (i, chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39), s) for i, p, s in KNOWN)}) select file_id, line_no, phrase, start from msg join known on i = (file_id * 31 + line_no) % {len(SENTENCES)} where side = 'assistant'")
def dictionary_hits(spark, d):
    """Every assistant message says one of SENTENCES; the default dictionary matches, guards included."""
    sentence = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod(F.col("file_id") * 31 + F.col("line_no"), F.lit(len(SENTENCES))) + 1).cast("int"))
    told = messages(spark, d).filter("side = 'assistant'").withColumn("norm", T.normalize(sentence))
    hits = told.select("file_id", "line_no", F.explode(Lexicon().assistant_hits("norm")).alias("h"))
    return hits.select("file_id", "line_no", "h.phrase", F.col("h.start").cast("int").alias("start"))


USERS = ("this is fucking stupid", "actually that isnt it, look at the parser output", "run the tests", "STOP. read it", 'it has loading="lazy" here', "you are so lazy about it")


@query(MSG + f""", said as (select *, (file_id * 31 + line_no) % {len(SENTENCES)} as i, (file_id * 17 + line_no) % {len(USERS)} as u from turned),
known(i, phrase, start) as (values {', '.join('(%d, %s, %d)' % (i, chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39), s) for i, p, s in KNOWN)}), heat(u, phrase, start) as (values (0, 'fucking', 8), (0, 'stupid', 16), (3, 'STOP', 0), (5, 'lazy', 11)),
usr2 as (select file_id, turn_id, case when u in (0, 3, 5) then 'hot' when u = 1 then 'correction' else 'neutral' end as bucket from said where side = 'user')
select s.file_id, s.line_no, s.side, phrase, start as char_offset, u.bucket as turn_bucket, 'p' || (s.file_id % 5) as project from said s join known k on k.i = s.i left join usr2 u using (file_id, turn_id) where s.side = 'assistant'
union all select s.file_id, s.line_no, s.side, phrase, start, 'hot', 'p' || (s.file_id % 5) from said s join heat h on h.u = s.u where s.side = 'user'""")
def match_rows_sentences(spark, d):
    """match_rows with the default dictionary over messages that say SENTENCES and USERS."""
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.col("file_id") * k + F.col("line_no"), F.lit(len(xs))) + 1).cast("int"))
    told = messages(spark, d).filter("side in ('user', 'assistant')").withColumn("text", F.when(F.col("side") == "user", pick(USERS, 17)).otherwise(pick(SENTENCES, 31)))
    rows = matches.match_rows(told)
    return rows.select("file_id", "line_no", "side", "phrase", F.col("char_offset").cast("int").alias("char_offset"), "turn_bucket", "project")
