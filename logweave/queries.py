"""Queries over the rendered corpus and the given tables, and the SQL that gives the same rows."""

from datetime import datetime

from pyspark.sql import functions as F

from . import sinks
from .corpus import events, log_lines
from .functions import text as T
from .operators import cluster, filtering, merge, timeline as tl, views
from .plans.parse import carry_forward, parse_lines
from .plans.query import Filter, Window

QUERIES, SQL = {}, {}

# What the corpus must parse to, straight from the events; shared by most of the SQL.
BASE = """
with e as (select event_id, user_id, date_trunc('second', ts) as ts, event_type,
  case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'NOTICE' when 'click' then 'INFO' when 'view' then 'DEBUG' end as lv,
  (user_id % 3)::int as source_idx, 'src' || (user_id % 3) as source, event_id % 8 as k, 'event ' || event_id || ' by user ' || user_id as body from events),
line as (
  select event_id, user_id, source, source_idx, 2 * event_id as line_no, ts as t,
    ['python-logging','syslog','syslog-5424','access-log','json','iso-level','iso','raw'][k + 1] as format_name,
    case when k = 7 then null else ts end as ts0, case k when 2 then 0 when 3 then 0 when 4 then 0 when 6 then 7200 end as off0,
    case k when 3 then case lv when 'ERROR' then 'ERROR' when 'WARN' then 'WARN' else 'INFO' end when 6 then null when 7 then null else lv end as level0,
    case k when 1 then '[' || lv || '] ' || body when 3 then 'GET /event/' || event_id || ' HTTP/1.1' when 7 then '~~ ' || body else body end as message,
    case when k = 3 then case lv when 'ERROR' then '500' when 'WARN' then '404' else '200' end end as status,
    case when k in (1, 2) then 'node' || (user_id % 5) when k = 3 then '10.0.0.' || (user_id % 200) end as host, lv, k
  from e
  union all
  select event_id, user_id, source, source_idx, 2 * event_id + 1, ts, 'raw', null, null, null, '    at pkg.Klass.run(Klass.java:9)', null, null, lv, 99 from e where event_id % 5 = 0),
folded as (
  select *, last_value(ts0 ignore nulls) over w as fts, last_value(case when ts0 is not null then coalesce(off0, -1) end ignore nulls) over w as foff, last_value(level0 ignore nulls) over w as flv
  from line window w as (partition by source order by line_no rows unbounded preceding)),
entry as (
  select *, coalesce(format_name = 'raw' and (fts is not null or flv is not null), false) as continuation,
    case when format_name = 'raw' then fts else ts0 end as ts, case when format_name = 'raw' then nullif(foff, -1) else off0 end as ts_offset_s, case when format_name = 'raw' then flv else level0 end as level
  from folded)
"""


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def parsed(spark, d):
    return parse_lines(log_lines(spark, d))


def entries(spark, d):
    return carry_forward(parsed(spark, d)).withColumn("node", F.lit(None).cast("string"))


@query("""
with b as (select date_trunc('second', ts) as ts, event_type as x from events where event_type = 'error' or (event_type = 'purchase' and false)),
r as (select min(ts) as lo, max(ts) as hi, greatest(1, date_diff('second', min(ts), max(ts))) // 60 + 1 as step, date_diff('second', min(ts), max(ts)) as span from b),
g as (select unnest(generate_series(0, span // step))::bigint as bucket, lo, step from r)
select bucket, lo + to_seconds(bucket * step) as bucket_start, lo + to_seconds((bucket + 1) * step) as bucket_end,
  (select count(*) from b where date_diff('second', g.lo, b.ts) // g.step = g.bucket) as n,
  case when (select count(*) from b where date_diff('second', g.lo, b.ts) // g.step = g.bucket) > 0 then 'ERROR' end as worst_level from g
""")
def timeline(spark, d):
    """Events as log lines of one format, parsed, errors only, over sixty buckets."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    lines = events(spark, d).select(F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("raw"))
    return tl.timeline(filtering.matching(parse_lines(lines), Filter(severity="error")), 60)


@query(BASE + "select source, line_no, format_name, ts0 as ts, off0::int as ts_offset_s, level0 as level, message, host, status from line")
def parse_formats(spark, d):
    field = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return parsed(spark, d).select("source", "line_no", "format_name", "ts", "ts_offset_s", "level", "message", field("host"), field("status"))


@query("select event_id, json_extract_string(props, '$.k') as k, event_type as type from events")
def parse_json_fields(spark, d):
    lines = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit('{"event":{"type":"'), "event_type", F.lit('"},"props":'), "props", F.lit("}")).alias("raw"))
    return parse_lines(lines).select("event_id", F.col("fields")["props.k"].alias("k"), F.col("fields")["event.type"].alias("type"))


@query(BASE + "select source, line_no, ts, ts_offset_s::int as ts_offset_s, level, continuation from entry")
def carry_forward_lines(spark, d):
    return carry_forward(parsed(spark, d), segment=500).select("source", "line_no", "ts", "ts_offset_s", "level", "continuation")


@query("select doc_id from documents where not regexp_matches(text, 'the|une', 'i')")
def filter_text_smartcase(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("raw"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.create_map().cast("map<string,string>").alias("fields"))
    return filtering.matching(docs, Filter("the|une", invert=True)).select("doc_id")


@query(BASE + "select source, line_no from entry where status is not null and status::int >= 400 and source = 'src1'")
def filter_terms(spark, d):
    return filtering.matching(entries(spark, d), Filter("status>=400 source=src1", known_keys=frozenset(("status", "source")))).select("source", "line_no")


@query(BASE + "select source, line_no, level from entry where level in ('ERROR', 'CRITICAL')")
def filter_severity(spark, d):
    return filtering.matching(entries(spark, d), Filter(severity="error")).select("source", "line_no", "level")


@query(BASE + "select source, line_no, ts from entry where ts between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-05 12:00:00'")
def filter_window(spark, d):
    return filtering.matching(entries(spark, d), Filter(window=Window(datetime(2024, 1, 2), datetime(2024, 1, 5, 12)))).select("source", "line_no", "ts")


SPEC = Filter("host:node user", severity="error", window=Window(datetime(2024, 1, 2), None))
FIELD_ROWS = """, f as (select source, line_no, case k when 1 then ['host', 'tag', 'pid'] when 2 then ['host', 'tag', 'pid'] when 3 then ['host', 'user', 'request', 'status', 'size'] when 4 then ['time', 'severity', 'msg', 'user.id'] end as keys,
  case k when 1 then [host, 'app', (event_id % 1000)::varchar] when 2 then [host, 'app', (event_id % 1000)::varchar] when 3 then [host, 'u' || user_id, message, status, (event_id % 5000)::varchar]
    when 4 then [strftime(ts0, '%Y-%m-%dT%H:%M:%SZ'), lower(lv), message, user_id::varchar] end as vals from line where k in (1, 2, 3, 4)),
field as (select source, line_no, unnest(keys) as key, unnest(vals) as value from f) """
VOCABULARY = BASE + FIELD_ROWS + "select key as name from field union select unnest(['host','tag','pid','msgid','ident','user','request','status','size','node'])"
OUTCOME = """case when host is null then 'mf' when not contains(host, 'node') then 'f' when not contains(lower(message), 'user') then 'q' when level is null then 'ml' when level not in ('ERROR', 'CRITICAL') then 's'
  when ts is null then 'mt' when ts < timestamp '2024-01-02' then 't' else 'k' end"""


@query(BASE + f"""select count(*) as total, count(*) filter (o = 'k') as matched, count(*) filter (o in ('f', 'mf', 'q')) as hidden_by_query, count(*) filter (o in ('s', 'ml')) as hidden_by_severity,
  count(*) filter (o in ('t', 'mt')) as hidden_by_time, count(*) filter (o = 'ml') as hidden_missing_level, count(*) filter (o = 'mt') as hidden_missing_timestamp, count(*) filter (o = 'mf') as hidden_missing_field
  from (select {OUTCOME} as o from entry)""")
def filter_stats(spark, d):
    return filtering.filter_stats(entries(spark, d), SPEC)


@query(BASE + "select count(*) as n from entry where contains(lower(message), 'user 1')")
def match_count(spark, d):
    return entries(spark, d).agg(F.count_if(filtering.matches(Filter("user 1"))).alias("n"))


@query(VOCABULARY)
def field_vocabulary(spark, d):
    return filtering.field_names(parsed(spark, d))


@query(BASE + ", s as (select min(ts) as lo, max(ts) as hi from entry where ts is not null), p as (select lo, greatest(1, date_diff('second', lo, hi)) // 24 + 1 as step, date_diff('second', lo, hi) as span from s), "
       "b as (select date_diff('second', lo, ts) // step as bucket, level from entry, p where ts is not null), g as (select unnest(generate_series(0, span // step))::bigint as bucket, lo, step from p) "
       "select g.bucket, any_value(lo + to_seconds(g.bucket * step)) as bucket_start, any_value(lo + to_seconds((g.bucket + 1) * step)) as bucket_end, count(b.bucket) as n, "
       "arg_max(level, list_position(['TRACE','DEBUG','INFO','NOTICE','WARN','ERROR','CRITICAL'], level)) as worst_level from g left join b using (bucket) group by g.bucket")
def timeline_levels(spark, d):
    return tl.timeline(entries(spark, d), 24)


@query("""with b as (select ts, user_id from (select date_trunc('second', ts) as ts, user_id from events)), r as (select min(ts) as lo, greatest(1, date_diff('second', min(ts), max(ts))) // 100 + 1 as step, date_diff('second', min(ts), max(ts)) as span from b),
c as (select date_diff('second', lo, ts) // step as bucket, count(*) as n from b, r group by 1) select span // step + 1 as buckets, span // step + 1 - (select count(*) from c) as empty, (select sum(n) from c)::bigint as total, (select max(n) from c) as peak from r""")
def timeline_gaps(spark, d):
    e = events(spark, d).withColumn("level", F.lit("INFO"))
    return tl.timeline(e, 100).agg(F.count("*").alias("buckets"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("total"), F.max("n").alias("peak"))


@query(BASE + """select source, line_no, case when k in (0, 2, 4, 5, 6) then 'event <int> by user <int>' when k = 1 then '[' || lv || '] event <int> by user <int>' when k = 3 then 'GET <path> HTTP<path>'
  when k = 7 then '~~ event <int> by user <int>' else 'at pkg.Klass.run(Klass.java:<int>)' end as shape from line""".replace("'GET <path> HTTP<path>'", "'GET <path> HTTP/<float>'"))
def normalise_tokens(spark, d):
    return parsed(spark, d).select("source", "line_no", T.normalised(F.col("message")).alias("shape"))


CLUSTERS = BASE + """, shaped as (select *, row_number() over (order by line_no) - 1 as pos, case when k in (0, 2, 4, 5, 6) then 'e' when k = 1 then '[' || lv when k = 3 then 'g' when k = 7 then '~' else 'a' end as shape from entry),
gaps as (select *, case when pos - lag(pos) over (partition by source, level, shape order by pos) <= 20 then 0 else 1 end as fresh from shaped),
isle as (select *, sum(fresh) over (partition by source, level, shape order by pos rows unbounded preceding) as island from gaps),
c as (select source, level, shape, island, count(*) as n, min(pos) as first_pos, max(pos) as last_pos, arg_min(ts, pos) filter (ts is not null) as first_ts, arg_max(ts, pos) filter (ts is not null) as last_ts, arg_min(message, pos) as message from isle group by all)
"""


def positioned(spark, d):
    from .plans.positions import with_position

    return with_position(entries(spark, d), "line_no")


@query(CLUSTERS + "select source, level, n, first_pos, last_pos, first_ts, last_ts, message from c")
def cluster_summary(spark, d):
    return cluster.summaries(positioned(spark, d), 20).select("source", "level", "n", "first_pos", "last_pos", "first_ts", "last_ts", "message")


@query(CLUSTERS + "select sum(n)::bigint as lines, count(*) as rows, coalesce(sum(n) filter (n >= 2), 0)::bigint as clustered_lines, count(*) filter (n >= 2) as clusters from c")
def cluster_totals(spark, d):
    return cluster.cluster_totals(cluster.summaries(positioned(spark, d), 20))


ANCHORED = ", stamped as (select *, last_value(case when ts0 is not null then ts0 end ignore nulls) over (partition by source order by line_no rows unbounded preceding) as moment from line where true) "


@query(BASE + ANCHORED + "select source, line_no, row_number() over (order by (moment is not null)::int, moment, source_idx, line_no) - 1 as pos, ts0 is null as anchored from stamped")
def merge_anchor(spark, d):
    return merge.merged(parsed(spark, d)).select("source", "line_no", "pos", "anchored")


@query(BASE + """, z as (select *, ts0 - to_seconds(coalesce(off0, [0, 3600, -18000][source_idx + 1])) - to_microseconds(case when source_idx = 2 then 1500000 else 0 end) as m0 from line),
stamped as (select *, last_value(m0 ignore nulls) over (partition by source order by line_no rows unbounded preceding) as moment from z)
select source, line_no, row_number() over (order by (moment is not null)::int, moment, source_idx, line_no) - 1 as pos from stamped""")
def merge_zones(spark, d):
    facts = spark.createDataFrame([("src0", "a", 0, 0.0, False), ("src1", "b", 3600, 2.0, False), ("src2", "c", -18000, 1.5, True)], "source string, node string, zone_offset_s int, skew_s double, correct_skew boolean")
    return merge.merged(parsed(spark, d), facts).select("source", "line_no", "pos")


@query(BASE + "select source, line_no, message from (select *, row_number() over (partition by source order by line_no desc) as r from line) where r <= 50")
def tail_last_n(spark, d):
    return views.last_lines(parsed(spark, d), 50).select("source", "line_no", "message")


@query("""with l as (select 'set' || (user_id % 2) as set_base, (event_id % 3)::int as member_rank, event_id as line_no from events),
r as (select *, row_number() over (partition by set_base order by member_rank, line_no desc) as n from l) select set_base, member_rank, line_no, row_number() over (partition by set_base order by n desc) - 1 as pos from r where n <= 300""")
def rotated_budget(spark, d):
    lines = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("set"), (F.col("user_id") % 2).cast("string")).alias("set_base"), (F.col("event_id") % 3).cast("int").alias("member_rank"), F.col("event_id").alias("line_no"))
    return views.rotated_tail(lines, 300)


@query(BASE + "select line_no, case when level = 'ERROR' then 1 else 0 end + case when status = '404' then 1 else 0 end as n_rules, concat_ws(',', case when level = 'ERROR' and contains(message, '7') then 'seven' end, case when status = '404' then 'lost' end) as hits from entry".replace("case when level = 'ERROR' then 1 else 0 end + case when status = '404' then 1 else 0 end as n_rules, ", "").replace("level = 'ERROR' and contains(message, '7')", "contains(message, 'event 7')"))
def watch_rules(spark, d):
    rules = {"seven": Filter("event 7"), "lost": Filter("status=404"), "empty": Filter(""), "broken": Filter("[")}
    e = views.watch_hits(entries(spark, d), rules)
    return e.select("line_no", F.concat_ws(",", "hits").alias("hits"))


@query(BASE + """select rule, count(*) as pending from (select unnest([case when contains(message, 'event 7') then 'seven' end, case when status = '404' then 'lost' end,
  case when contains(host, 'node1') then 'node' end]) as rule from entry) where rule is not null group by rule""")
def watch_pending(spark, d):
    """The hits of each rule over all entries; rules without terms, or that cannot be understood, have none."""
    rules = {"seven": Filter("event 7"), "lost": Filter("status=404"), "node": Filter("host:node1"), "empty": Filter(""), "broken": Filter("[")}
    hits = views.watch_hits(entries(spark, d), rules)
    return hits.select(F.explode("hits").alias("rule")).groupBy("rule").agg(F.count("*").alias("pending"))


@query()
def watch_rate_limit(spark, d):
    hits = events(spark, d).select(F.col("event_type").alias("rule"), F.col("ts").alias("at"))
    return views.rate_limited(hits, 3600.0)


@query(BASE + "select source, line_no from entry where format_name = 'python-logging' and source = 'src0'")
def marked_lines(spark, d):
    e = entries(spark, d)
    marks = e.where("format_name = 'python-logging' and source = 'src0'").select("source", views.digest().alias("digest"))
    return views.marked(e, marks).select("source", "line_no")


@query(BASE + "select line_no, ts from entry where ts >= timestamp '2024-01-03 06:00:00' order by line_no limit 1")
def goto_time(spark, d):
    return views.first_at(entries(spark, d), datetime(2024, 1, 3, 6), "line_no").select("line_no", "ts")


@query(BASE + ", m as (select line_no from entry where contains(message, 'event 9')) select line_no, row_number() over (order by line_no) as k, (select count(*) from m) as n, coalesce(lead(line_no) over (order by line_no), (select min(line_no) from m)) as next, coalesce(lag(line_no) over (order by line_no), (select max(line_no) from m)) as previous from m")
def next_match(spark, d):
    return views.steps(entries(spark, d), Filter("event 9"), "line_no")


@query(BASE + "select source, arg_max(level, list_position(['TRACE','DEBUG','INFO','NOTICE','WARN','ERROR','CRITICAL'], level)) as worst from entry group by source")
def level_worst_by_source(spark, d):
    return entries(spark, d).groupBy("source").agg(T.worst_level(F.col("level")).alias("worst"))


@query(BASE + """select bool_or(ts is not null) as has_time, count(distinct ts::date) > 1 as has_date, bool_or(date_part('microsecond', ts) % 1000000 <> 0) as has_fraction, bool_or(level is not null) as has_level,
  count(distinct source) > 1 as has_source, count(distinct host) > 1 as varies_host, count(distinct status) > 1 as varies_status, false as varies_ident from entry""")
def column_plan(spark, d):
    return views.column_plan(entries(spark, d), ("host", "status", "ident"))


@query(BASE + """select source, line_no, case when k in (1, 2) then 'app' when k = 3 then host end as speaker, case when k in (1, 2) then (event_id % 1000)::varchar end as pid,
  case when k in (1, 2) then 'host=' || host when k = 3 then 'status=' || status || ' user=u' || user_id || ' size=' || (event_id % 5000) else '' end as chips, message as body from line""")
def structured_rows(spark, d):
    rows = views.structured_rows(parsed(spark, d))
    return rows.select("source", "line_no", "speaker", "pid", F.array_join(F.transform("chips", lambda c: F.concat_ws("=", c["key"], c["value"])), " ").alias("chips"), "body")


@query(BASE + "select source, count(distinct message) as n from line where k = 0 group by source")
def marks_by_source(spark, d):
    marks = parsed(spark, d).where("format_name = 'python-logging'").select("source", views.digest().alias("digest"))
    return views.marks_by_source(marks)


@query(BASE + FIELD_ROWS + "select source, line_no, key, value from field")
def field_properties(spark, d):
    return views.properties(parsed(spark, d))


@query("select event_id, 'JSON' as label from events where json_valid(props)")
def payload_kind(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", views.payload(F.col("props"))["label"].alias("label")).where("label is not null")


@query()
def payload_pages(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", views.payload(F.col("html"))["label"].alias("label"))


@query(BASE + """select '{"raw":"' || strftime(ts0, '%Y-%m-%d %H:%M:%S') || ' - ' || lv || ' - ' || message || '","timestamp":"' || strftime(ts0, '%Y-%m-%dT%H:%M:%S') || '","level":"' || lv || '","message":"' || message
  || '","format":"python-logging","continuation":false,"fields":{"source":"' || source || '"}}' as value from line where k = 0""")
def export_jsonl(spark, d):
    return sinks.json_lines(entries(spark, d).where("format_name = 'python-logging'"))


@query(BASE + """select strftime(ts0, '%Y-%m-%dT%H:%M:%S') || case when k = 6 then '+02:00' else '' end as timestamp, coalesce(lv, '') as level, format_name as format, 'false' as continuation, message, '' as node, '' as fields from (select * replace (case when k = 6 then null else lv end as lv) from line) where k in (0, 5, 6)""")
def export_csv(spark, d):
    return sinks.csv_rows(entries(spark, d).where("format_name in ('python-logging', 'iso-level', 'iso')")).drop("raw")


@query(CLUSTERS + "select source, case when n >= 2 then '×' || n || ' ' || message else message end as message, first_ts as ts, case when n >= 2 then n::varchar end as count from c")
def export_clustered(spark, d):
    out = sinks.clustered(cluster.summaries(positioned(spark, d), 20))
    return out.select("source", "message", "ts", F.try_element_at("fields", F.lit("cluster.count")).alias("count"))


@query("select doc_id, regexp_replace(text, '[0-9]+', '<n>', 'g') as text from documents")
def redact_stage(spark, d):
    from .plugins import run_stages

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return run_stages(docs, [lambda df, ctx: df.withColumn("text", F.regexp_replace("text", "[0-9]+", "<n>"))])


@query("""with c as (select distinct conv_id, turn, role from conversations), s as (select *, 10000 * conv_id + turn as line_no, case when turn % 3 <> 1 then timestamp '2024-01-01' + to_seconds(conv_id % 7 + 60 * turn) end as ts,
  case role when 'system' then 0 when 'user' then 1 else 2 end as source_idx from c),
m as (select *, last_value(ts ignore nulls) over (partition by source_idx, role order by line_no rows unbounded preceding) as moment from s)
select conv_id, turn, role, row_number() over (order by (moment is not null)::int, moment, source_idx, line_no) - 1 as pos, ts is null as anchored from m""")
def merge_conversations(spark, d):
    """Turns as lines of a source for each role, every third one without a stamp, merged by time."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role").distinct()
    stamp = F.timestamp_add("SECOND", F.col("conv_id") % 7 + 60 * F.col("turn"), F.lit("2024-01-01").cast("timestamp_ntz"))
    lines = turns.select("conv_id", "turn", "role", F.col("role").alias("source"), F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).alias("source_idx"),
                         (10000 * F.col("conv_id") + F.col("turn")).alias("line_no"), F.when(F.col("turn") % 3 != 1, stamp).alias("ts"), F.lit(None).cast("int").alias("ts_offset_s"))
    return merge.merged(lines).select("conv_id", "turn", "role", "pos", "anchored")


RAW = """, written as (select *, 'event ' || event_id || ' by user ' || user_id as body, case lv when 'ERROR' then '3' when 'WARN' then '4' when 'NOTICE' then '5' when 'INFO' then '6' when 'DEBUG' then '7' end as sev, strftime(t, '%Y-%m-%d %H:%M:%S') as iso from line),
raws as (select *, case k when 0 then iso || ' - ' || lv || ' - ' || body
  when 1 then strftime(t, '%b') || ' ' || lpad(day(t)::varchar, 2, ' ') || strftime(t, ' %H:%M:%S ') || host || ' app[' || (event_id % 1000) || ']: [' || lv || '] ' || body
  when 2 then '<' || (128 + sev::int) || '>1 ' || strftime(t, '%Y-%m-%dT%H:%M:%SZ ') || host || ' app ' || (event_id % 1000) || ' - - ' || body
  when 3 then host || ' - u' || user_id || strftime(t, ' [%d/%b/%Y:%H:%M:%S +0000] "GET /event/') || event_id || ' HTTP/1.1" ' || status || ' ' || (event_id % 5000)
  when 4 then '{"time":"' || strftime(t, '%Y-%m-%dT%H:%M:%SZ') || '","severity":"' || lower(lv) || '","msg":"' || body || '","user":{"id":' || user_id || '}}'
  when 5 then '[' || iso || '] [' || lower(lv) || '] ' || body when 6 then strftime(t, '%Y-%m-%dT%H:%M:%S+02:00 ') || body else message end as raw from written)
"""


@query(BASE + RAW + ", r as (select *, sum(octet_length(encode(raw)) + 1) over (partition by source order by line_no desc rows unbounded preceding) as b from raws) select source, line_no, raw from r where b <= 5000")
def copy_suffix(spark, d):
    return views.byte_suffix(parsed(spark, d), 5000).select("source", "line_no", "raw")
