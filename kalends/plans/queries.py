"""One query per operator over the driver's tables, and the same in SQL.

SQL is DuckDB's. Operators that SQL can't express have none here; tests hold
them against brute force.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as TM
from ..operators import calendar_merge, contact_duplicates, contact_merge, event_duplicates, placements, recurrence, rows, search, timezones, zone_text
from ..operators import series as recurring
from ..operators.components import connected_components
from ..operators.search import ranked
from ..session import stored
from ..sinks import csv, ics, vcf
from ..sources.ics import legacy_blocks, parse_ics, recovery
from ..sources.properties import named
from ..sources.vcf import parse_vcf
from .tables import calendar_events, contacts, recurring_events, series, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RAW = "case event_id % 4 when 0 then strftime(ts, '%Y%m%dT%H%M%SZ') when 3 then strftime(ts, '%Y%m%d') else strftime(ts, '%Y%m%dT%H%M%S') end"
VALUE = "case event_id % 4 when 3 then strftime(ts, '%Y-%m-%d') else strftime(ts, '%Y-%m-%dT%H:%M:%S') end"
VALUE_END = "case event_id % 4 when 3 then '' else strftime(ts + interval 1 hour, '%Y-%m-%dT%H:%M:%S') end"
ZONE = "case event_id % 4 when 0 then 'UTC' when 1 then 'America/New_York' when 2 then 'Floating' else 'All-day' end"
KIND = "case event_id % 4 when 0 then 'utc' when 1 then 'zoned' when 2 then 'floating' else 'date' end"
RESOLVES = "timezone('America/New_York', timezone('America/New_York', date_trunc('second', ts))) = date_trunc('second', ts)"


@query("""
with s as (select event_id as idx, case when event_id % 4 = 0 then 'uid-' || event_id % 997 else '' end as uid, case when event_id % 8 = 0 then 'r' || event_id % 3 else '' end as instance, lower(event_type) as title, date_trunc('hour', ts) as start, user_id from events),
k as (select idx, uid, instance, 0 as rank, 'c' || uid || '|' || instance as key from s where uid <> '' union all select idx, uid, instance, 1, 'l' || title || '|' || start || '|' || user_id from s union all select idx, uid, instance, 2, 'p' || title || '|' || start from s),
o as (select *, first_value(idx) over w as owner, first_value(uid) over w as owner_uid, first_value(instance) over w as owner_instance from k window w as (partition by key order by idx)),
ok as (select * from o where owner < idx and not (uid <> '' and uid = owner_uid and instance <> owner_instance))
select idx, arg_min(owner, rank)::bigint as owner, min(rank)::int as rank from ok group by idx
""")
def event_dup_candidates(spark, d):
    """JN1, JN2, WIN1, FN-S1: each event and the first holder of its strongest shared key, instances of one UID apart."""
    k = F.col("event_id")
    uid, instance = F.when(k % 4 == 0, F.concat(F.lit("uid-"), k % 997)).otherwise(""), F.when(k % 8 == 0, F.concat(F.lit("r"), k % 3))
    e = table(spark, d, "events").select(k.alias("idx"), uid.alias("uid"), instance.alias("identity"), F.col("event_type").alias("title"), F.date_trunc("hour", "ts").alias("start_key"), F.lit("").alias("end_key"), F.col("user_id").cast("string").alias("location"))
    return event_duplicates.owner_pairs(event_duplicates.with_seeds(e))


@query()
def event_dup_exact_order(spark, d):
    """§2.13-D with the rule that paired events don't register weaker keys."""
    e = calendar_events(spark, d)
    rows_ = e.select("idx", "uid", F.lit(None).cast("string").alias("identity"), "title", F.col("start").alias("start_key"), F.col("end").alias("end_key"), "location")
    return event_duplicates.candidates(rows_)


@query(f"select event_id as idx, event_type as title from events where contains(lower(event_type || ' room ' || user_id % 50 || ' ' || props || ' user' || user_id || '@example.com a@example.com b' || user_id || '@example.com'), 'room 7') and substr({VALUE}, 1, 10) >= '2024-01-10' and {ZONE} = 'America/New_York' and event_id % 5 = 0")
def event_search(spark, d):
    """FLT1, FLT2, FLT3."""
    return search.search_events(calendar_events(spark, d), "Room 7", "2024-01-10", "America/New_York", True).select("idx", "title")


@query(f"""
select event_type as title, case when event_id % 4 = 0 then {VALUE} || '.000Z' else {VALUE} end as start, case when event_id % 4 = 0 then {VALUE_END} || '.000Z' else {VALUE_END} end as "end", {ZONE} as timezone, {KIND} as time_kind,
event_id % 4 = 3 as all_day, 'Room ' || user_id % 50 as location, props as description, 'user' || user_id || '@example.com' as organizer, 'a@example.com; b' || user_id || '@example.com' as attendees, event_type as categories,
case when event_id % 5 = 0 then 'FREQ=WEEKLY;COUNT=4' else '' end as recurrence_rule, 'CONFIRMED' as status, 'uid-' || event_id % 997 as uid, 'events.ics' as source_file from events
""")
def event_csv_rows(spark, d):
    """PRJ1, PRJ2, PRJ5."""
    return rows.event_rows(calendar_events(spark, d))


@query(f"select event_type as title, {VALUE} as start, case event_id % 4 when 0 then 'UTC' when 1 then 'Time zone' when 2 then 'Floating' else 'All-day' end as time_kind, case when event_id % 5 = 0 then 'Yes' else 'No' end as recurring, event_id as idx from events")
def event_viewer_rows(spark, d):
    """PRJ7."""
    e = calendar_events(spark, d)
    return rows.viewer_rows(e.withColumn("source_file", F.col("idx").cast("string"))).select("title", "start", "time_kind", "recurring", F.col("source_file").cast("long").alias("idx"))


@query(f"select '\"' || replace(props, '\"', '\"\"') || '\"' as description, event_id as idx, event_id || ',' || (case when contains(props, ',') or contains(props, '\"') then '\"' || replace(props, '\"', '\"\"') || '\"' else props end) || ',' || event_type as line from events")
def csv_lines(spark, d):
    """SNK1."""
    e = calendar_events(spark, d)
    return e.select(csv.cell(F.col("description")).alias("description"), "idx", csv.line(["idx", "description", "title"]).alias("line"))


@query(f"select count(*) as total, count(*) filter ({KIND} = 'utc') as utc, count(*) filter ({KIND} = 'zoned') as zoned, count(*) filter ({KIND} = 'floating') as floating, count(*) filter ({KIND} = 'date') as date from events")
def tz_analysis(spark, d):
    """AGG1."""
    return timezones.analyze(calendar_events(spark, d)).select("total", "utc", "zoned", "floating", "date")


@query(f"select {ZONE} as zone, count(*) as events from events group by 1")
def tz_histogram(spark, d):
    """AGG2."""
    return timezones.histogram(calendar_events(spark, d))


@query(f"""
with e as (select event_id, date_trunc('second', ts) as ts, {KIND} as kind, event_id % 5 = 0 as recurring, {RESOLVES} as resolves from events),
r as (select *, case when kind = 'date' then 'unchanged' when kind = 'floating' then 'warning' when kind = 'zoned' and not resolves then 'blocked' when recurring then 'blocked' else 'changed' end as result from e)
select event_id as idx, result, case when result = 'changed' then strftime(timezone('Europe/Lisbon', case kind when 'utc' then timezone('UTC', ts) else timezone('America/New_York', ts) end), '%Y%m%dT%H%M%S') else case kind when 'utc' then strftime(ts, '%Y%m%dT%H%M%SZ') when 'date' then strftime(ts, '%Y%m%d') else strftime(ts, '%Y%m%dT%H%M%S') end end as new_raw from r
""")
def tz_convert(spark, d):
    """TG11, FN-T4, FN-T9, PRJ9: conversion to Lisbon time."""
    return timezones.preview(calendar_events(spark, d), "convert", "Europe/Lisbon").select("idx", "result", F.col("new_start.raw").alias("new_raw"))


@query(f"select case when event_id % 4 = 2 then 'changed' else 'unchanged' end as result, count(*) as n from events group by 1")
def tz_assign(spark, d):
    """TG11, AGG15: floating times set in Lagos, which has no gaps or folds."""
    return timezones.preview(calendar_events(spark, d), "assign", "Africa/Lagos").groupBy("result").agg(F.count("*").alias("n"))


@query("""
with o as (select o_orderkey, date_trunc('day', o_orderdate)::timestamp - case when o_orderkey % 2 = 1 then interval 30 minute else interval 0 minute end as wall from orders),
i as (select *, timezone('America/Sao_Paulo', wall) as instant from o),
k as (select *, timezone('America/Sao_Paulo', instant) <> wall as skipped, timezone('America/Sao_Paulo', instant - interval 1 hour) = wall or timezone('America/Sao_Paulo', instant + interval 1 hour) = wall as repeated from i)
select o_orderkey, case when skipped or repeated then 'blocked' else 'changed' end as result, case when skipped then 'NONEXISTENT_LOCAL_TIME' when repeated then 'AMBIGUOUS_LOCAL_TIME' else '' end as code from k
""")
def tz_assign_gaps(spark, d):
    """TG11: floating midnights, and half hours before, set in a zone that skips some of the ones and repeats some of the others."""
    o = table(spark, d, "orders")
    wall = F.date_trunc("day", "o_orderdate").cast("timestamp") - F.make_dt_interval(mins=F.when(F.col("o_orderkey") % 2 == 1, 30).otherwise(0))
    none = F.lit(None).cast(TM.TIME)
    times = F.array().cast(f"array<{TM.TIME}>")
    e = o.select("o_orderkey", TM.typed(F.date_format(wall, "yyyyMMdd'T'HHmmss"), F.lit(""), F.lit(False)).alias("start_time"), none.alias("end_time"), none.alias("recurrence_id"), times.alias("rdates"), times.alias("exdates"), F.lit("").alias("rrule"))
    return timezones.preview(e, "assign", "America/Sao_Paulo").select("o_orderkey", "result", "code")


@query(f"""
with e as (select event_id, {KIND} as kind, event_id % 5 = 0 as recurring, {RESOLVES} as resolves from events),
r as (select *, case when kind = 'date' then 'unchanged' when kind = 'floating' then 'warning' when kind = 'zoned' and not resolves then 'blocked' when recurring then 'blocked' else 'changed' end as result from e),
x as (select 'eligible' as scope, result from r union all select 'floating', case when kind = 'floating' then result else 'unchanged' end from r
  union all select 'matching', case when kind in ('zoned', 'floating') then result else 'unchanged' end from r union all select 'selected', case when event_id % 3 = 0 then result else 'unchanged' end from r)
select scope, count(*) filter (result = 'changed') as changed, count(*) filter (result = 'blocked') as blocked, count(*) filter (result = 'warning') as warning, count(*) filter (result = 'unchanged') as unchanged from x group by 1
""")
def tz_scopes(spark, d):
    """FLT7, JN13, AGG15: what a conversion does to all events, those in a zone, those without one, and chosen ones."""
    # times are made once for all scopes
    e = stored(calendar_events(spark, d).select("idx", "start_time", "end_time", "recurrence_id", "rdates", "exdates", "rrule"))
    chosen = table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("idx"))
    each = [timezones.result_counts(timezones.preview_scope(e, s, "convert", "Europe/Lisbon", "America/New_York", chosen)).select(F.lit(s).alias("scope"), "*") for s in timezones.SCOPES]
    return functools.reduce(DataFrame.unionByName, each)


@query("select o_orderkey, case when timezone('America/Sao_Paulo', timezone('America/Sao_Paulo', date_trunc('day', o_orderdate))) = date_trunc('day', o_orderdate) then 'valid' else 'nonexistent' end as status from orders")
def wall_time_resolution(spark, d):
    """FN-T5, FN-T6: midnights in a zone whose clocks skip some."""
    o = table(spark, d, "orders")
    wall = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    return o.select("o_orderkey", TM.wall_status(TM.wall_instants(wall, F.lit("America/Sao_Paulo"))).alias("status"))


@query(f"select event_id as idx, case event_id % 4 when 0 then 'utc:' || {VALUE} when 1 then 'zoned:America/New_York:' || {RAW} when 2 then 'floating:' || {RAW} else 'date:' || {RAW} end as key from events")
def time_keys(spark, d):
    """FN-T2, FN-T3, FN-T7, FN-T11."""
    return calendar_events(spark, d).select("idx", TM.time_key(F.col("start_time")).alias("key"))


@query("select o_orderkey, (o_orderkey % 3) * 604800 + (o_orderkey % 5) * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 as seconds from orders")
def duration_seconds(spark, d):
    """FN-T10."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("P"), k % 3, F.lit("W"), k % 5, F.lit("DT"), k % 24, F.lit("H"), k % 60, F.lit("M"))
    return table(spark, d, "orders").select("o_orderkey", TM.duration_seconds(text).alias("seconds"))


@query(r"""
with p as (select doc_id, regexp_extract(text, '\+1 \([0-9]{3}\) 555-[0-9]{4}') as phone, regexp_extract(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+[A-Za-z0-9]') as email from documents)
select doc_id, regexp_replace(phone, '[ ().-]+', '', 'g') as phone, lower(email) as email from p
""")
def phone_email_normalize(spark, d):
    """FN-S3, FN-S4."""
    t = table(spark, d, "documents")
    phone, email = F.regexp_extract("text", r"\+1 \([0-9]{3}\) 555-[0-9]{4}", 0), F.regexp_extract("text", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+[A-Za-z0-9]", 0)
    return t.select("doc_id", T.normalize_phone(phone).alias("phone"), T.normalize_email(email).alias("email"))


@query("select c_custkey, lower(regexp_replace(c_name, '#', ' ')) as name, levenshtein(c_name, reverse(c_name)) as d, case when c_name = reverse(c_name) then 1.0 else 1 - levenshtein(c_name, reverse(c_name)) / length(c_name)::double end as similarity from customer")
def name_similarity(spark, d):
    """FN-S5, FN-S7."""
    c = table(spark, d, "customer")
    back = F.reverse("c_name")
    return c.select("c_custkey", T.normalize_name(F.col("c_name")).alias("name"), F.levenshtein("c_name", back).cast("long").alias("d"), T.name_similarity(F.col("c_name"), back).alias("similarity"))


@query("select doc_id, lower(strip_accents(text)) as key from documents")
def search_keys(spark, d):
    """FN-S6."""
    return table(spark, d, "documents").select("doc_id", T.search_key(F.col("text")).alias("key"))


@query("select doc_id, case when regexp_matches(text, '^[\\t\\r\\n ]*[=+\\-@]') then '''' || text else text end as text from (select doc_id, case when doc_id % 3 = 0 then ' =' || text when doc_id % 3 = 1 then '-' || text else text end as text from documents)")
def formula_protect(spark, d):
    """PRJ6."""
    t = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" ="), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), "text")).otherwise(F.col("text"))
    return t.select("doc_id", T.protect_formula(text).alias("text"))


@query("select page_id, regexp_replace(regexp_replace(url, '\\.[^.]+$', ''), '[^A-Za-z0-9_-]+', '-', 'g') as stem, lower(split_part(url, ':', 1)) in ('http', 'https') as safe from pages")
def page_names(spark, d):
    """SNK3, FN-S12."""
    return table(spark, d, "pages").select("page_id", T.file_stem(F.col("url")).alias("stem"), T.is_safe_url(F.col("url")).alias("safe"))


@query("select conv_id, turn, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), ';', chr(92) || ';'), ',', chr(92) || ',') as escaped, text as back from conversations")
def text_escapes(spark, d):
    """FN-S9, FN-S10, FN-S11."""
    escaped = T.escape_ics(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", escaped.alias("escaped"), T.unescape_text(escaped).alias("back"))


@query("select doc_id, greatest(0, floor(length(b) * 3 / 4)::bigint - (length(b) - length(rtrim(b, '='))))::bigint as bytes from (select doc_id, to_base64(encode(text)) as b from documents)")
def media_bytes(spark, d):
    """FN-M2, SRC20."""
    return table(spark, d, "documents").select("doc_id", T.base64_bytes(F.base64(F.encode("text", "UTF-8"))).alias("bytes"))


START, END = "1995-01-01", "1996-12-31"


@query(f"select o_orderkey::varchar as series_id, o_orderdate::timestamp + to_days(3 * k::int) as start from orders, range(0, 40) r(k) where o_orderdate::timestamp + to_days(3 * k::int) between timestamp '{START} 00:00:00' and timestamp '{END} 23:59:59'")
def rrule_daily(spark, d):
    """TG2, TG3, FLT9: every third day, forty times."""
    return recurrence.expand_rules(series(spark, d, "FREQ=DAILY;INTERVAL=3;COUNT=40"), START, END)


@query(f"select o_orderkey::varchar as series_id, o_orderdate::timestamp + to_days(7 * k::int) as start from orders, range(0, 300) r(k) where o_orderdate::timestamp + to_days(7 * k::int) between timestamp '{START} 00:00:00' and timestamp '1995-06-30 23:59:59'")
def rrule_weekly_until(spark, d):
    """TG2, FN-T13."""
    return recurrence.expand_rules(series(spark, d, "FREQ=WEEKLY;UNTIL=19950630"), START, END)


@query("""
with m as (select o_orderkey, o_orderdate::timestamp as dtstart, o_orderdate::timestamp - o_orderdate::date::timestamp as clock, k from orders, range(0, 8) r(k)),
c as (select o_orderkey, dtstart, (date_trunc('month', dtstart)::date + to_months(k::int) + to_days(14)) + clock as start from m)
select o_orderkey::varchar as series_id, start from (select *, row_number() over (partition by o_orderkey order by start) as n from c where start >= dtstart) where n <= 6 and start between timestamp '1995-01-01 00:00:00' and timestamp '1996-12-31 23:59:59'
""")
def rrule_monthly(spark, d):
    """TG2 by the general way: the 15th of six months."""
    return recurrence.expand_rules(series(spark, d, "FREQ=MONTHLY;BYMONTHDAY=15;COUNT=6"), START, END)


@query(f"""
with o as (select o_orderkey as k, o_orderdate::timestamp as began from orders),
d as (select d::date as d, isodow(d) as w, day(d) as n, day(last_day(d)) as z from (select unnest(generate_series(timestamp '1992-01-01', timestamp '{END}', interval 1 day)) as d)),
chosen as (select 0 as rule, max(d) as d from d where w <= 5 group by year(d), month(d) union all select 1, d from d where (w = 2 and (n - 1) // 7 = 1) or (w = 5 and (z - n) // 7 = 0) union all select 3, d from d where month(d) = 2 and n in (29, z - 1)),
x as (select k, rule, d::timestamp as start, row_number() over (partition by k order by d) as i from o join chosen on rule = k % 4 and d >= began::date
  union all select k, 2, began + to_hours(37 * n), 0 from o, range(0, 2000) r(n) where k % 4 = 2 and isodow(began + to_hours(37 * n)) = 6)
select k::varchar as series_id, start from x where (rule <> 1 or i <= 30) and start between timestamp '{START} 00:00:00' and timestamp '{END} 23:59:59'
""")
def rrule_parts(spark, d):
    """TG2, TG3: the last workday of a month, thirty Tuesdays and Fridays by their place in it, every 37 hours on Saturdays, days of February."""
    k = F.col("series_id").cast("long") % 4
    rule = F.when(k == 0, "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1").when(k == 1, "FREQ=MONTHLY;BYDAY=2TU,-1FR;COUNT=30").when(k == 2, "FREQ=HOURLY;INTERVAL=37;BYDAY=SA").otherwise("FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29,-2")
    return recurrence.expand_rules(series(spark, d, "").withColumn("rrule", rule), START, END)


@query("select o_orderkey::varchar as series_id, least(10, ceil(731 / 7.0 / (1 + o_orderkey % 3)))::bigint + o_orderkey % 4 as estimate from orders")
def work_estimates(spark, d):
    """AGG4."""
    o = table(spark, d, "orders")
    rule = F.concat(F.lit("FREQ=WEEKLY;COUNT=10;INTERVAL="), 1 + F.col("o_orderkey") % 3)
    return o.select(F.col("o_orderkey").cast("string").alias("series_id"), recurrence.work_estimate(rule, F.lit(731), F.col("o_orderkey") % 4).alias("estimate"))


def _sources(spark, d):
    own = series(spark, d, "FREQ=DAILY;COUNT=5")
    masters = own.select("series_id", F.col("dtstart").alias("start"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("series_id"), "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("ship"))
    dated = lines.join(masters, "series_id")
    added = dated.where("l_linenumber = 1").select("series_id", F.col("ship").alias("start"))
    out = dated.where("l_linenumber = 2").select("series_id", (F.col("start").cast("timestamp") + F.expr("interval '1' day")).cast("timestamp_ntz").alias("start"))
    return recurrence.combine(masters, recurrence.expand_rules(own, "1995-01-01", "1996-06-30"), added, out, "1995-01-01", "1996-06-30")


_COMBINED = """
m as (select o_orderkey as k, o_orderdate::timestamp as start from orders),
every as (select k, start, 0 as p from m union all select k, start + to_days(n::int), 1 from m, range(0, 5) r(n) union all select m.k, l_shipdate::timestamp, 2 from m join lineitem on l_orderkey = k where l_linenumber = 1),
once as (select k, start, min(p) as p from every where start::date between date '1995-01-01' and date '1996-06-30' group by 1, 2),
gone as (select m.k, m.start + interval 1 day as start from m join lineitem on l_orderkey = k where l_linenumber = 2),
c as (select * from once where not exists (select 1 from gone g where g.k = once.k and g.start = once.start))
"""


@query(f"with {_COMBINED} select k::varchar as series_id, start, case p when 0 then 'master' when 1 then 'rrule' else 'rdate' end as source from c")
def occurrence_sources(spark, d):
    """JN5, SET2, SET3."""
    return _sources(spark, d)


@query(f"""
with {_COMBINED},
o as (select k, start + interval 2 day as start, start + interval 2 day + interval 3 hour as new_start, k % 4 = 0 as cancelled from m where k % 2 = 0 union all select k, start + interval 20 day, start + interval 20 day, false from m where k % 2 = 0 and k % 3 = 0),
b as (select coalesce(c.k, o.k) as k, coalesce(c.start, o.start) as identity, c.p, o.new_start, o.cancelled from c full join o on c.k = o.k and c.start = o.start)
select k::varchar as series_id, identity, coalesce(new_start, identity) as start, case when p is null then 'override' when p = 0 then 'master' when p = 1 then 'rrule' else 'rdate' end as source,
case when new_start is not null and cancelled then 'Cancelled' when new_start is not null then 'Modified occurrence' when p = 2 then 'RDATE' else 'Recurring' end as status, new_start is not null and p is null as mismatch
from b where new_start is null or (cancelled and p is not null) or new_start::date between date '1995-01-01' and date '1996-06-30'
""")
def occurrence_overrides(spark, d):
    """JN6, JN7, WIN4, PRJ8."""
    m = series(spark, d, "").withColumn("k", F.col("series_id").cast("long"))
    at = lambda days, hours=0: (F.col("dtstart").cast("timestamp") + F.make_dt_interval(F.lit(days), F.lit(hours))).cast("timestamp_ntz")
    moved = m.where("k % 2 = 0").select("series_id", at(2).alias("identity"), at(2, 3).alias("new_start"), (F.col("k") % 4 == 0).alias("cancelled"))
    extra = m.where("k % 2 = 0 and k % 3 = 0").select("series_id", at(20).alias("identity"), at(20).alias("new_start"), F.lit(False).alias("cancelled"))
    return recurrence.override(_sources(spark, d), moved.unionByName(extra), "1995-01-01", "1996-06-30")


@query("""
with o as (select o_custkey::varchar as series_id, o_orderdate::timestamp as start, o_orderkey from orders),
r as (select *, row_number() over (partition by series_id order by start, o_orderkey) as n, least(5, count(*) over (partition by series_id)) as have from o),
s as (select series_id, max(have) as have from r group by 1), b as (select series_id, have, coalesce(sum(have) over (order by series_id rows between unbounded preceding and 1 preceding), 0) as before from s)
select r.series_id, r.start, r.o_orderkey as identity from r join b using (series_id) where n <= 5 and n <= greatest(0, least(5, 2000 - before))
""")
def occurrence_caps(spark, d):
    """WIN3, LIM3."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("series_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("start"), F.col("o_orderkey").alias("identity"))
    return recurrence.capped(o, 5, 2000).select("series_id", "start", "identity")


@query("select o_orderkey::varchar as series_id, case o_orderkey % 4 when 0 then 'Every day for 3 times' when 1 then 'Every 2 weeks on Monday, Friday' when 2 then 'Every month on the 1st Monday, the last Friday' else 'Complex recurrence rule' end as text from orders")
def rule_texts(spark, d):
    """TG5."""
    k = F.col("o_orderkey") % 4
    rule = F.when(k == 0, "FREQ=DAILY;COUNT=3").when(k == 1, "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,FR").when(k == 2, "FREQ=MONTHLY;BYDAY=1MO,-1FR").otherwise("FREQ=DAILY;BYHOUR=3")
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("series_id"), recurrence.rule_text(rule).alias("text"))


_SERIES = f"""
e as (select event_id, event_type, event_id - event_id % 5 as m, date_trunc('second', ts) as ts from events where event_id % 5 <= 1),
f as (select *, m % 4 as kind, case when m % 4 = 3 then date_trunc('day', ts) else ts end as wall from e),
master as (select * from f where event_id % 5 = 0), over as (select o.*, o.event_id % 10 = 1 as cancelled, master.wall + interval 7 day as identity from f o join master on master.m = o.m where o.event_id % 5 = 1),
rule as (select m, event_type, kind, wall + to_days(7 * n::int) as identity, n from master, range(0, 4) r(n) where (wall + to_days(7 * n::int))::date between date '2024-01-01' and date '2024-01-31'),
x as (select coalesce(r.m, o.m) as m, coalesce(r.identity, o.identity) as identity, coalesce(o.wall, r.identity) as start, coalesce(o.event_type, r.event_type) as title, coalesce(o.kind, r.kind) as kind, o.m is not null as modified, coalesce(o.cancelled, false) as cancelled, r.n from rule r full join over o on o.m = r.m and o.identity = r.identity
 where o.m is null or (o.cancelled and r.m is not null) or o.wall::date between date '2024-01-01' and date '2024-01-31')
"""
_SHOWN = "case kind when 3 then strftime({0}, '%Y-%m-%d') when 0 then strftime({0}, '%Y-%m-%dT%H:%M:%S.000Z') else strftime({0}, '%Y-%m-%dT%H:%M:%S') end"


@query(f"""
with {_SERIES} select 'series-' || m || '::' || m as series_id, title, {_SHOWN.format("start")} as occurrence_start, {_SHOWN.format("identity")} as recurrence_id, case kind when 0 then 'UTC' when 1 then 'America/New_York' when 2 then 'Floating' else 'All-day' end as timezone, kind = 3 as all_day,
case when modified then 'override' when n = 0 then 'master' else 'rrule' end as occurrence_source, modified, case when cancelled then 'Cancelled' when modified then 'Modified occurrence' else 'Recurring' end as status, modified and n is null as mismatch from x where m in (select m from master)
""")
def event_occurrences(spark, d):
    """TG1, TG3, TG4, JN7, PRJ8: occurrences of all series of a calendar's events."""
    from dataclasses import replace

    every = replace(recurring.LIMITS, occurrences=2**40)  # all series, not the first ones
    x = recurring.expand_events(recurring_events(spark, d), "2024-01-01", "2024-01-31", limits=every)
    return x.occurrences.select("series_id", "title", "occurrence_start", "recurrence_id", "timezone", "all_day", "occurrence_source", "modified", "status", "mismatch")


@query(f"with {_SERIES} select (select count(*) from master) as recurring_series, 0::bigint as series_with_exclusions, 0::bigint as series_with_additions, (select count(*) from over) as series_with_overrides, 0::bigint as unsupported_series")
def recurrence_counters(spark, d):
    """TG1, AGG3."""
    return recurring.counters(recurring.recurrence_series(recurring_events(spark, d)).series)


@query(f"""
with {_SERIES} select code, count(*) as n from (select 'RECURRENCE_OVERRIDE_MISMATCH' as code from x where modified and n is null and m in (select m from master) union all select 'MISSING_RECURRENCE_MASTER' from f where event_id % 5 = 1 and m not in (select m from master)) group by 1
""")
def recurrence_diagnostics(spark, d):
    """TG1, TG3: what an expansion tells."""
    from dataclasses import replace

    every = replace(recurring.LIMITS, occurrences=2**40)
    return recurring.expand_events(recurring_events(spark, d), "2024-01-01", "2024-01-31", limits=every).diagnostics.groupBy("code").agg(F.count("*").alias("n"))


_KEYS = """
c as (select c_custkey as k, c_nationkey as n, c_mktsegment as seg, case when c_custkey % 6 = 0 then 'uid-' || c_custkey % 1200 else '' end as uid, case when c_custkey % 4 = 0 then '' else 'user' || c_custkey % 1300 || '@example.com' end as email,
 '+1555010' || lpad((c_custkey % 1100)::varchar, 4, '0') as phone, 'given' || c_custkey % 83 || ' family' || c_custkey % 71 as name, 'family' || c_custkey % 71 as family,
 '||street ' || c_custkey % 900 || '|town ' || c_nationkey || '|||' as address, lower(c_mktsegment) as org, case when c_custkey % 5 = 0 then '19' || lpad((c_custkey % 97)::varchar, 2, '0') || '-01-01' else '' end as born from customer),
keys as (select k, 1 as rank, uid as key from c union all select k, 2, email from c union all select k, 3, phone from c union all select k, 4, name from c union all select k, 5, address from c
 union all select k, 6, case when org <> '' then org || '|' || family else '' end from c union all select k, 7, case when born <> '' then born || '|' || family else '' end from c),
b as (select rank, key, count(distinct k) as n from keys where key <> '' group by 1, 2),
ok as (select distinct keys.k, keys.rank, keys.key from keys join b using (rank, key) where n > 1 and n <= case when rank < 4 then 1000 else 100 end),
pairs as (select x.k as a, y.k as b, min(x.rank) as rank from ok x join ok y on x.rank = y.rank and x.key = y.key and x.k < y.k group by 1, 2)
"""


@query(f"with {_KEYS} select (select count(*) from customer) as contacts, count(*) as candidate_pairs, (select count(*) from b where rank >= 4 and n > 100) as weak_buckets_skipped, (select count(*) from b where rank < 4 and n > 1000) as strong_buckets_skipped from pairs")
def contact_metrics(spark, d):
    """AGG8: the counts of a duplicate analysis."""
    rows_ = stored(contact_duplicates.prepared(contacts(spark, d)))
    seeds, found = contact_duplicates.pair_seeds(contact_duplicates.blocking_keys(rows_))
    none = spark.createDataFrame([], "members array<long>, confidence string, exact boolean")
    m = contact_duplicates.metrics(rows_, seeds, seeds.limit(0), none, found)
    return m.select("contacts", "candidate_pairs", "weak_buckets_skipped", "strong_buckets_skipped")


@query(f"""
with {_KEYS}, seen as (select rank, key, min(k) as seen from ok group by 1, 2),
f as (select x.k as a, y.k as b, min(x.rank) as rank, arg_min(seen, x.rank) as seen from ok x join ok y on x.rank = y.rank and x.key = y.key and x.k < y.k join seen on seen.rank = x.rank and seen.key = x.key group by 1, 2)
select a, b, rank::int as rank from f order by f.rank, seen, a, b limit 500
""")
def contact_pairs_capped(spark, d):
    """WIN5: the pairs that a cap leaves, those of the first index and place."""
    from dataclasses import replace

    limits = replace(contact_duplicates.LIMITS, candidate_pairs=500)
    return contact_duplicates.pair_seeds(contact_duplicates.blocking_keys(stored(contact_duplicates.prepared(contacts(spark, d)))), limits)[0]


@query(f"with {_KEYS} select a, b, rank::int as rank from pairs")
def contact_pairs(spark, d):
    """JN3: the pairs that blocking proposes, all of them."""
    return contact_duplicates.pair_seeds(contact_duplicates.blocking_keys(stored(contact_duplicates.prepared(contacts(spark, d)))))[0]


_SCORED = f"""
with {_KEYS},
j as (select a, b, x.uid <> '' and x.uid = y.uid as uid, x.email <> '' and x.email = y.email as email, x.phone = y.phone as phone, x.name = y.name as name,
 case when x.name = y.name then 1.0 else 1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name))::double end as sim, x.org = y.org as org, x.address = y.address as address, x.born <> '' and x.born = y.born as born,
 x.email <> '' and y.email <> '' and x.email <> y.email and x.phone <> y.phone as apart from pairs join c x on x.k = a join c y on y.k = b),
s as (select *, uid and sim < 0.45 and apart as conflict from j),
t as (select *, 90 * uid::int + 75 * email::int + 70 * phone::int + 25 * name::int + 15 * (not name and sim >= 0.84)::int + 15 * org::int + 20 * address::int + 20 * born::int - 35 * conflict::int as score,
 uid::int + email::int + phone::int as strong, name or sim >= 0.84 or org or address or born as supporting from s),
r as (select a, b, score::int as score, case when (uid and not conflict) or strong >= 2 then 'certain' when strong = 1 and not conflict and (supporting or score >= 65) then 'likely' when strong = 1 then 'possible' when score >= 45 then 'likely' when score >= 30 then 'possible' end as confidence, sim as similarity from t)
"""


@query(_SCORED + "select a, b, score, confidence, round(similarity, 9) as similarity from r where confidence is not null")
def contact_scores(spark, d):
    """TG8, JN4, SET4."""
    r = stored(contact_duplicates.prepared(contacts(spark, d)))
    owners, _ = contact_duplicates.usable_buckets(contact_duplicates.blocking_keys(r))
    return contact_duplicates.scored_pairs(r, owners).select("a", "b", "score", "confidence", F.round("similarity", 9).alias("similarity"))


@query()
def contact_group_order(spark, d):
    """SRT5, FLT8, AGG11: the first sure groups in order, and how many groups there are of each confidence."""
    g = contact_duplicates.find_duplicates(contacts(spark, d)).groups
    counts = contact_duplicates.confidence_histogram(g).select("place", "confidence", "groups", "members", F.lit("").alias("first_members"))
    first = contact_duplicates.filter_groups(g, "certain").orderBy(*contact_duplicates.group_order()).limit(100)
    listed = first.select(F.lit(-1).alias("place"), "confidence", F.lit(1).cast("long").alias("groups"), F.size("members").cast("long").alias("members"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("first_members"))
    return counts.unionByName(listed)


@query()
def contact_groups(spark, d):
    """TG7, AGG9: groups with the cap on members; uncapped components are `components`."""
    g = contact_duplicates.find_duplicates(contacts(spark, d)).groups
    return g.select("group", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "confidence", "exact", F.array_join("reasons", ",").alias("reasons"))


@query()
def components(spark, d):
    """TG7 without the cap: orders and parts that hang together. Recursive SQL doesn't end on the whole table."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 10000000).alias("b"))
    return connected_components(e)


@query("""
select a.o_custkey as node, min(b.o_custkey) as component from orders a join orders b on a.o_custkey % 1000 = b.o_custkey % 1000 group by 1
""")
def chain_components(spark, d):
    """TG7 without the cap: customers that order one after another, by their number's last three digits."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    after = F.lead("k").over(Window.partitionBy(F.col("k") % 1000).orderBy("k"))
    return connected_components(o.select(F.col("k").alias("a"), F.coalesce(after, "k").alias("b"))).unionByName(o.join(o.groupBy((F.col("k") % 1000).alias("m")).agg(F.count("*").alias("n")).where("n = 1"), F.col("k") % 1000 == F.col("m")).select(F.col("k").alias("node"), F.col("k").alias("component")))


def _groups(spark, d):
    return contacts(spark, d).select((F.floor(F.col("idx") / 50)).alias("group"), "idx")


@query("""
with c as (select c_custkey as k, 4 + 3 * (c_custkey % 6 = 0)::int + 2 + 2 * (c_custkey % 3 = 0)::int + 2 * (c_custkey % 5 = 0)::int + 2 * (c_custkey % 7 = 0)::int + 2 * (c_custkey % 4 <> 0)::int + 2 + 2 as rich from customer)
select k // 50 as "group", k as idx from (select *, row_number() over (partition by k // 50 order by rich desc, k) as n from c) where n = 1
""")
def merge_primary(spark, d):
    """WIN7, FN-M1."""
    return contact_merge.primaries(contacts(spark, d), _groups(spark, d)).select("group", "idx")


@query("""
with l as (select c_custkey // 50 as g, c_custkey as k, 'organization' as field, c_mktsegment as value, lower(c_mktsegment) as key from customer union all select c_custkey // 50, c_custkey, 'title', 'Buyer', 'buyer' from customer where c_custkey % 3 = 0),
f as (select g, field, key, min(k) as k, arg_min(value, k) as value from l group by 1, 2, 3)
select g as "group", field, string_agg(value || '@' || k, ',' order by k) as choices, count(*) > 1 as conflict from f group by 1, 2
""")
def merge_plan(spark, d):
    """TG9, WIN8, AGG13, SET6."""
    p = contact_merge.plan(contacts(spark, d), _groups(spark, d)).where(F.col("field").isin("organization", "title"))
    return p.select("group", "field", F.array_join(F.transform("choices", lambda x: F.concat(x["value"], F.lit("@"), x["idx"])), ",").alias("choices"), "conflict")


@query("""
select c_custkey // 50 as "group", string_agg(v, ',' order by k) as emails from (select c_custkey // 50 as g, min(c_custkey) as k, c_custkey, 'User' || c_custkey % 1300 || '@Example.com' as v,
 row_number() over (partition by c_custkey // 50, c_custkey % 1300 order by c_custkey) as n from customer where c_custkey % 4 <> 0 group by c_custkey) where n = 1 group by 1
""")
def merge_emails(spark, d):
    """SET5: united mail addresses, the first spelling kept."""
    m = contact_merge.apply(contacts(spark, d), _groups(spark, d))
    return m.select("group", F.array_join(F.transform("emails", lambda e: e["value"]), ",").alias("emails")).where("emails <> ''")


@query("""
with r as (select o_orderkey as seq, o_custkey as g, case when o_orderkey % 3 = 0 then 'merge' else 'keep' end as type from orders)
select g as "group", arg_max(type, seq) as type, max(seq) as seq from r group by 1
""")
def latest_resolutions(spark, d):
    """WIN6, TG10: the last decision of each group (undo and reset in tests)."""
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("group"), F.when(F.col("o_orderkey") % 3 == 0, "merge").otherwise("keep").alias("type"))
    return contact_merge.latest(r)


@query("""
with c as (select * from customer), e as (select c_custkey as k, 0 as p, 'email' as f, 'User' || c_custkey % 1300 || '@Example.com' as v, 'home' as t from c where c_custkey % 4 <> 0
 union all select c_custkey, 1, 'phone', '+1 (555) 010-' || lpad((c_custkey % 1100)::varchar, 4, '0'), 'cell' from c union all select c_custkey, 2, 'address', 'Street ' || c_custkey % 900, 'home' from c)
select '0:' || k || ':' || c_name as id, (row_number() over (partition by k order by p) - 1)::int as position, f as repeated_field, v as repeated_value, t as repeated_types, '' as repeated_preference from e join c on c_custkey = k
""")
def contact_long_rows(spark, d):
    """PRJ4."""
    return rows.long_rows(contacts(spark, d))


@query("""
select c_name as full_name, 'Given' || c_custkey % 83 as given_name, 'Family' || c_custkey % 71 as family_name, c_mktsegment as organization, case when c_custkey % 3 = 0 then 'Buyer' else '' end as job_title,
case when c_custkey % 4 = 0 then '' else 'User' || c_custkey % 1300 || '@Example.com' end as emails, '+1 (555) 010-' || lpad((c_custkey % 1100)::varchar, 4, '0') as phones, 'Street ' || c_custkey % 900 as addresses, '' as websites,
case when c_custkey % 5 = 0 then '19' || lpad((c_custkey % 97)::varchar, 2, '0') || '-01-01' else '' end as birthday, '' as categories, case when c_custkey % 7 = 0 then '''=note ' || c_custkey else '' end as notes, '3.0' as vcard_version,
case when c_custkey % 6 = 0 then 'uid-' || c_custkey % 1200 else '' end as uid, 'customer.vcf' as source_file from customer
""")
def contact_csv_rows(spark, d):
    """PRJ3, PRJ6."""
    return rows.contact_rows(contacts(spark, d))


@query("select c_custkey as idx from customer where c_custkey % 4 <> 0 and contains(lower(c_name || ' given' || c_custkey % 83 || ' family' || c_custkey % 71), 'family7')")
def contact_search(spark, d):
    """FLT4, FLT5."""
    return search.search_contacts(contacts(spark, d), "FÁMILY7", presence="email").select("idx")


@query("select count(*) as contacts, count(*) filter (c_custkey % 4 <> 0) as with_email, count(*) as with_phone, count(*) filter (c_mktsegment <> '') as with_organization from customer")
def contact_presence(spark, d):
    """AGG12."""
    return search.presence_counts(contacts(spark, d))


@query("select c_custkey as idx from customer order by c_acctbal, c_custkey limit 100 offset 200")
def contact_page(spark, d):
    """LIM1, LIM2: the third page."""
    return search.page(table(spark, d, "customer").withColumnRenamed("c_custkey", "idx"), ["c_acctbal", "idx"], 3).select("idx")


@query("select o_orderpriority as code, min(o_orderkey) as first from orders group by 1")
def first_diagnostics(spark, d):
    """WIN2."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderkey").alias("first"))
    return search.first_diagnostics(o, ["code"], ["first"])


def _metadata(spark, d):
    n = table(spark, d, "nation")
    lines = F.array(F.lit("X-SHARED:1"), F.concat(F.lit("X-REGION:"), F.col("n_regionkey")))
    zone = F.concat(F.lit("BEGIN:VTIMEZONE\nTZID:Zone"), F.col("n_regionkey"), F.lit("\nX:"), F.col("n_nationkey") % 2, F.lit("\nEND:VTIMEZONE"))
    same = lambda v: F.lit(v)
    return n.select(F.col("n_nationkey").alias("source_index"), same("").alias("method"), same("GREGORIAN").alias("calscale"), F.col("n_name").alias("name"), same("All").alias("description"), F.when(F.col("n_nationkey") == 3, "UTC").otherwise("").alias("timezone"), same("").alias("refresh_interval"), same("").alias("color"), same("").alias("source"), lines.alias("vendor_properties"), F.array(zone).alias("vtimezones"))


@query("select '2.0' as version, 'Merged calendar' as name, 'All' as description, 'UTC' as timezone, 'name' as warnings")
def merged_metadata(spark, d):
    """AGG6, §2.13-G."""
    return calendar_merge.merged_metadata(_metadata(spark, d)).select("version", "name", "description", "timezone", F.array_join("warnings", ",").alias("warnings"))


@query("select 0 as position, 'X-SHARED:1' as line")
def shared_vendor_lines(spark, d):
    """AGG7, SET7."""
    return calendar_merge.shared_vendor_lines(_metadata(spark, d))


@query("select 'zone' || n_regionkey as tzid, min(n_nationkey) as source_index, count(distinct n_nationkey % 2) > 1 as differs from nation group by n_regionkey")
def zone_definitions(spark, d):
    """JN8."""
    first, differing = calendar_merge.zone_definitions(_metadata(spark, d))
    return first.join(differing.withColumn("d", F.lit(True)), "tzid", "left").select("tzid", "source_index", F.coalesce("d", F.lit(False)).alias("differs"))


@query("""
with s as (select event_id as idx, lower(event_type) as title, date_trunc('hour', ts) as start from events), k as (select idx, min(idx) over (partition by title, start) as owner from s)
select 1::bigint as sources, (select count(*) from events) as events, (select count(*) from k where owner < idx) as candidates, (select count(*) from events where event_id % 3 <> 0) as included, 5::bigint as definitions, (select count(*) from orders where o_orderpriority = '1-URGENT') as malformed
""")
def merge_summary(spark, d):
    """AGG5, SNK11, JN12."""
    e = calendar_events(spark, d).select("idx", "source_index")
    rows_ = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.lit("").alias("uid"), F.lit(None).cast("string").alias("identity"), F.col("event_type").alias("title"), F.date_trunc("hour", "ts").alias("start_key"), F.lit("").alias("end_key"), F.col("event_id").cast("string").alias("location"))
    pairs = event_duplicates.owner_pairs(event_duplicates.with_seeds(rows_))
    bad = F.col("o_orderpriority") == "1-URGENT"
    found = table(spark, d, "orders").select(F.when(bad, "error").otherwise("warning").alias("severity"), F.when(bad, "MALFORMED_EVENT").otherwise("MISSING_UID").alias("code"))
    return calendar_merge.summary(e, pairs, calendar_merge.zone_definitions(_metadata(spark, d))[0], found, e.where("idx % 3 = 0"))


@query(f"""
select event_id as idx, 'uid-' || event_id % 997 as uid, event_type as title, props as description, 'Room ' || user_id % 50 as location, {VALUE} as start, {VALUE_END} as "end", {ZONE} as timezone, case when event_id % 5 = 0 then 'FREQ=WEEKLY;COUNT=4' else '' end as rrule from events
""")
def ics_roundtrip(spark, d):
    """SRC3, SRC5-12, SNK4, SNK5, SNK7: events written as calendars, by user and FILE_ROWS ids, and read back."""
    back = parse_ics(_calendars(spark, d)).events
    own = F.get(named(F.col("raw_properties"), "X-IDX"), F.lit(0))["value"].cast("long")
    return back.select(own.alias("idx"), "uid", "title", "description", "location", "start", "end", "timezone", "rrule")


#: Ids that go into one file, so that no file grows with its user or nation.
FILE_ROWS = 10_000


def _calendars(spark, d):
    """FILES rows of the events, each with its id as a vendor property. Rows are dealt by file, so texts aren't shuffled."""
    e = calendar_events(spark, d, user_id=F.col("user_id"), part=F.floor(F.col("event_id") / FILE_ROWS))
    own = F.concat(F.lit("X-IDX:"), F.col("idx"))
    empty = F.lit("")
    e = e.withColumn("raw_properties", F.array(F.struct(empty.alias("group"), F.lit("X-IDX").alias("name"), F.col("idx").cast("string").alias("value"), F.expr("cast(map() as map<string,array<string>>)").alias("parameters"), own.alias("raw"))))
    texts = ics.event_text(e, ["user_id", "part", "idx"])
    body = F.array_join(F.sort_array(F.collect_list(F.struct("idx", "text")))["text"], "\r\n")
    files = texts.groupBy("user_id", "part").agg(F.concat(F.lit(ics.HEAD + "\r\n"), body, F.lit("\r\nEND:VCALENDAR\r\n")).alias("text"))
    return files.select(F.col("user_id").cast("int").alias("source_index"), F.concat("user_id", F.lit("-"), "part", F.lit(".ics")).alias("source_file"), "text")


@query("""
select c_name as formatted_name, 'Given' || c_custkey % 83 as given_name, 'Family' || c_custkey % 71 as family_name, c_mktsegment as organization, case when c_custkey % 4 = 0 then '' else 'User' || c_custkey % 1300 || '@Example.com' end as email,
'+1 (555) 010-' || lpad((c_custkey % 1100)::varchar, 4, '0') as phone, 'Street ' || c_custkey % 900 as street, 'Town ' || c_nationkey as town, case when c_custkey % 7 = 0 then '=note ' || c_custkey else '' end as note, '4.0' as version from customer
""")
def vcf_roundtrip(spark, d):
    """SRC4, SRC14-19, SNK6: contacts written as vCards, by nation and FILE_ROWS ids, and read back."""
    c = contacts(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), "c_nationkey"), "idx")
    texts = vcf.contact_text(c, ["c_nationkey", "idx"]).withColumn("part", F.floor(F.col("idx") / FILE_ROWS))
    files = texts.groupBy("c_nationkey", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\r\n").alias("text"))
    back = parse_vcf(files.select(F.col("c_nationkey").cast("int").alias("source_index"), F.lit("nation.vcf").alias("source_file"), "text")).contacts
    first = lambda c, f="value": F.coalesce(F.get(c, F.lit(0))[f], F.lit(""))
    return back.select("formatted_name", "given_name", "family_name", "organization", first("emails").alias("email"), first("phones").alias("phone"), first("addresses", "street").alias("street"), first("addresses", "locality").alias("town"), F.coalesce(F.get("notes", F.lit(0)), F.lit("")).alias("note"), "version")


@query("select user_id::int as source_index, count(*)::int as events, 0 as malformed from events group by 1")
def legacy_event_blocks(spark, d):
    """SRC13, SNK9."""
    b = _calendars(spark, d).select("source_index", legacy_blocks(F.col("text")).alias("b"))
    return b.groupBy("source_index").agg(F.sum(F.size("b.events")).cast("int").alias("events"), F.sum("b.malformed").cast("int").alias("malformed"))


def _placed(spark, d):
    """Parts as placed records, some of them unsound."""
    k = F.col("p_partkey")
    start = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    end = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300 + k % 90).cast("int")), "yyyy-MM-dd")
    place = F.get(F.array(*map(F.lit, placements.PLACES)), (k % 5).cast("int"))
    return table(spark, d, "part").select(
        k.cast("string").alias("id"), F.col("p_name").alias("name"), F.when(k % 11 == 0, " ").otherwise("d").alias("description"), F.when(k % 13 == 0, "http://x/y.png").otherwise("/sponsors/a.png").alias("image"),
        F.when(k % 7 == 0, "http://a.b/").otherwise("https://a.b/").alias("url"), start.alias("start_date"), end.alias("end_date"), F.lit("l").alias("label"), (k % 2 == 0).alias("is_active"), F.array(place).alias("placement"),
    )


_PLACED = "p as (select p_partkey as k, p_partkey % 300 as s, p_partkey % 300 + p_partkey % 90 as e, p_partkey % 11 <> 0 and p_partkey % 13 <> 0 and p_partkey % 7 <> 0 and p_partkey % 90 > 0 as sound from part)"


@query("select p_partkey::varchar as id, concat_ws(';', case when p_partkey % 90 = 0 then 'dates' end, case when p_partkey % 11 = 0 then 'description' end, case when p_partkey % 13 = 0 then 'image' end, case when p_partkey % 7 = 0 then 'url' end) as errors from part")
def record_errors(spark, d):
    """FLT14."""
    return _placed(spark, d).select("id", F.array_join(placements.errors(), ";").alias("errors"))


@query(f"with {_PLACED} select k::varchar as id from p where sound and k % 2 = 0 and s <= 100 and 100 < e and k % 5 in (1, 3)")
def active_records(spark, d):
    """FLT13."""
    return placements.active(_placed(spark, d), "2024-04-10", "ics-tools").select("id")


@query(f"""
with {_PLACED}, a as (select k % 5 as c from p where sound and k % 2 = 0 and s <= 100 and 100 < e), u as (select 'homepage' as placement, 3 as total, count(*) filter (c = 0) as n from a union all select 'ics-tools', 1000, count(*) filter (c in (1, 3)) from a union all select 'vcf-tools', 1000, count(*) filter (c in (2, 3)) from a)
select placement, total::bigint as total, least(total, n)::bigint as active, (total - least(total, n))::bigint as available from u
""")
def placement_inventory(spark, d):
    """AGG16."""
    return placements.inventory(_placed(spark, d), "2024-04-10", {"homepage": 3, "ics-tools": 1000, "vcf-tools": 1000})


@query("select o_custkey, case when count(*) <= 1 then '1' when count(*) <= 5 then '2-5' else '6+' end as bucket from orders group by 1")
def count_buckets(spark, d):
    """FN-M3."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(placements.count_bucket(F.count("*")).alias("bucket"))


@query("""
with u as (select c_custkey // 50 as g, c_custkey, u.field, u.value from customer, lateral (values ('formatted_name', c_name), ('given_name', 'Given' || c_custkey % 83), ('family_name', 'Family' || c_custkey % 71), ('organization', c_mktsegment), ('title', case when c_custkey % 3 = 0 then 'Buyer' else '' end), ('role', ''),
 ('birthday', case when c_custkey % 5 = 0 then '19' || lpad((c_custkey % 97)::varchar, 2, '0') || '-01-01' else '' end), ('nickname', ''), ('uid', case when c_custkey % 6 = 0 then 'uid-' || c_custkey % 1200 else '' end)) u(field, value))
select g as "group", field, string_agg(value, ',' order by c_custkey) as values from u group by 1, 2
""")
def contact_comparison(spark, d):
    """PRJ10, PRJ14: groups of fifty side by side."""
    c = rows.comparison(contacts(spark, d), _groups(spark, d), ["formatted_name", "given_name", "family_name", "organization", "title", "role", "birthday", "nickname", "uid"])
    return c.select("group", "field", F.array_join("values", ",").alias("values"))


@query("select '0:' || c_custkey || ':' || c_name as id, u.field, u.value from customer, lateral (values ('formatted_name', c_name), ('given_name', 'Given' || c_custkey % 83), ('family_name', 'Family' || c_custkey % 71), ('organization', c_mktsegment), ('title', case when c_custkey % 3 = 0 then 'Buyer' end), ('birthday', case when c_custkey % 5 = 0 then '19' || lpad((c_custkey % 97)::varchar, 2, '0') || '-01-01' end), ('uid', case when c_custkey % 6 = 0 then 'uid-' || c_custkey % 1200 end)) u(field, value) where u.value is not null")
def contact_details(spark, d):
    """PRJ11."""
    return rows.detail_rows(contacts(spark, d))


@query("select c_custkey as idx, rank() over (order by c_acctbal) as rank from customer")
def sort_ranks(spark, d):
    """An order as ranks, without one task for all rows: counts of ranges come before."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), "c_acctbal")
    return search.ranked(c, "c_acctbal").select("idx", "rank")


@query("select c_custkey as idx from customer order by lower(c_mktsegment), c_custkey limit 50")
def contact_order(spark, d):
    """SRT2: contacts by organization, the first page."""
    return search.sort_contacts(contacts(spark, d), "organization").limit(50).select("idx")


@query(f"select event_id as idx from events order by {VALUE}, event_id limit 50")
def event_order(spark, d):
    """SRT1: events by start, the first page."""
    return search.sort_events(calendar_events(spark, d)).limit(50).select("idx")


@query(f"with {_SERIES} select 'series-' || m || '::' || m as series_id, {_SHOWN.format('start')} as occurrence_start from x where modified and not cancelled and m in (select m from master) order by start, m, identity limit 50")
def occurrence_order(spark, d):
    """SRT3, FLT6: modified occurrences by start, the first page."""
    from dataclasses import replace

    x = recurring.expand_events(recurring_events(spark, d), "2024-01-01", "2024-01-31", limits=replace(recurring.LIMITS, occurrences=2**40))
    found = search.filter_occurrences(x.occurrences, "modified").orderBy("start", F.col("idx") - F.col("idx") % 5, "recurrence_id").limit(50)
    return found.select("series_id", "occurrence_start")


@query(f"with s as (select distinct {ZONE} as zone from events) select zone, row_number() over (order by zone) - 1 as position from s")
def filter_domains(spark, d):
    """AGG17, SRT6: the zones that a list of events can be filtered by, in order."""
    return search.domain(calendar_events(spark, d), "timezone").select(F.col("value").alias("zone"), "position")


@query(_SCORED + "select a, b, score, confidence from r where confidence is not null order by case confidence when 'certain' then 0 when 'likely' then 1 else 2 end, score desc, a, b limit 50")
def pair_order(spark, d):
    """SRT4: the surest pairs, the first page."""
    r = stored(contact_duplicates.prepared(contacts(spark, d)))
    owners, _ = contact_duplicates.usable_buckets(contact_duplicates.blocking_keys(r))
    return contact_duplicates.scored_pairs(r, owners).orderBy(*contact_duplicates.pair_order()).limit(50).select("a", "b", "score", "confidence")


@query("""
with c as (select c_custkey // 50 as g, count(*) as contacts, sum((c_custkey % 4 <> 0)::int + 2) as repeated, count(distinct c_name) as names, count(distinct 'Given' || c_custkey % 83) as given, count(distinct 'Family' || c_custkey % 71) as family, count(distinct c_mktsegment) as org,
 count(distinct case when c_custkey % 5 = 0 then c_custkey % 97 end) as born, count(distinct case when c_custkey % 6 = 0 then c_custkey % 1200 end) as uids from customer group by 1)
select g as "group", contacts, ((names > 1)::int + (given > 1)::int + (family > 1)::int + (org > 1)::int + (born > 1)::int + (uids > 1)::int)::bigint as conflicts, repeated::bigint as repeated_values, 0::bigint as vendor_properties, 0::bigint as media from c
""")
def merge_counters(spark, d):
    """AGG13."""
    return contact_merge.plan_counters(contacts(spark, d), _groups(spark, d))


def _zone_files(spark, d):
    """FILES rows with one start per order: by key in UTC, in Lisbon, floating, in an unknown zone."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    at = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T013000"))
    line = F.when(k == 0, F.concat(F.lit("DTSTART:"), at, F.lit("Z"))).when(k == 1, F.concat(F.lit("DTSTART;TZID=Europe/Lisbon:"), at)).when(k == 2, F.concat(F.lit("DTSTART:"), at)).otherwise(F.concat(F.lit("DTSTART;TZID=Nowhere/X:"), at))
    return o.select(F.col("o_orderkey").cast("int").alias("source_index"), F.lit("o.ics").alias("source_file"), F.concat(F.lit("BEGIN:VEVENT\r\n"), line, F.lit("\r\nEND:VEVENT\r\n")).alias("text"))


_AT = "strftime(o_orderdate, '%Y%m%d') || 'T013000'"
_LISBON = "timezone('Europe/Lisbon', o_orderdate::date::timestamp + interval 90 minute)"


@query(f"""
with o as (select o_orderkey::int as source_index, o_orderkey % 4 as k, {_AT} as raw, timezone('Europe/Lisbon', {_LISBON}) = o_orderdate::date::timestamp + interval 90 minute as shown from orders)
select source_index, 2 as line, 'DTSTART' as property, raw as value, case k when 2 then 'floating' when 3 then 'unknown' else 'nonexistent' end as kind from o where k = 2 or k = 3 or (k = 1 and not shown)
""")
def zone_issues(spark, d):
    """FN-T8: what inspecting a calendar's text finds, but for repeated hours, whose rules changed over the years."""
    return zone_text.inspect_zones(_zone_files(spark, d))[1].where("kind <> 'ambiguous'")


@query(f"""
select o_orderkey::int as source_index, 'BEGIN:VEVENT' || chr(13) || chr(10) || case o_orderkey % 4 when 0 then 'DTSTART:' || {_AT} || 'Z' when 1 then 'DTSTART;TZID=Europe/Lisbon:' || {_AT} when 2 then 'DTSTART;TZID=Asia/Tokyo:' || {_AT} else 'DTSTART;TZID=Nowhere/X:' || {_AT} end || chr(13) || chr(10) || 'END:VEVENT' || chr(13) || chr(10) as assigned,
 'BEGIN:VEVENT' || chr(13) || chr(10) || case o_orderkey % 4 when 0 then 'DTSTART;TZID=Asia/Tokyo:' || strftime(o_orderdate::date::timestamp + interval 630 minute, '%Y%m%dT%H%M%S') when 1 then case when timezone('Europe/Lisbon', {_LISBON}) = o_orderdate::date::timestamp + interval 90 minute and timezone('Europe/Lisbon', {_LISBON} - interval 1 hour) <> timezone('Europe/Lisbon', {_LISBON}) and timezone('Europe/Lisbon', {_LISBON} + interval 1 hour) <> timezone('Europe/Lisbon', {_LISBON}) then 'DTSTART;TZID=Asia/Tokyo:' || strftime(timezone('Asia/Tokyo', {_LISBON}), '%Y%m%dT%H%M%S') else 'DTSTART;TZID=Europe/Lisbon:' || {_AT} end when 2 then 'DTSTART;TZID=Asia/Tokyo:' || strftime(o_orderdate::date::timestamp + interval 630 minute, '%Y%m%dT%H%M%S') else 'DTSTART;TZID=Nowhere/X:' || {_AT} end || chr(13) || chr(10) || 'END:VEVENT' || chr(13) || chr(10) as converted
from orders
""")
def zone_rewrites(spark, d):
    """FN-T8: floating starts put into a zone, and all starts converted."""
    f = _zone_files(spark, d)
    return f.select("source_index", zone_text.assign_zone(F.col("text"), "Asia/Tokyo").alias("assigned"), zone_text.convert_zone(F.col("text"), "UTC", "Asia/Tokyo").alias("converted"))


@query("""
select o_orderkey::int as source_index, 'o.ics' as source_file, (case o_orderkey % 4 when 1 then 2 when 2 then 1 else 4 end)::int as line, 'error' as severity, case o_orderkey % 4 when 2 then 'MALFORMED_EVENT' else 'TRUNCATED_COMPONENT' end as code from orders where o_orderkey % 4 <> 0
""")
def recovery_scan(spark, d):
    """SRC8: markers that don't pair up, by line."""
    k = F.col("o_orderkey") % 4
    texts = ["BEGIN:VEVENT\r\nEND:VEVENT", "x\r\nBEGIN:VEVENT\r\nBEGIN:VEVENT\r\nEND:VEVENT", "END:VEVENT\r\nBEGIN:VEVENT\r\nEND:VEVENT", "BEGIN:VEVENT\nSUMMARY:x\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:y"]
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("source_index"), F.lit("o.ics").alias("source_file"), F.get(F.array(*map(F.lit, texts)), k.cast("int")).alias("text"))
    return recovery(o)


@query("select c_custkey as idx, c_mktsegment as organization, case when c_custkey % 5 = 0 then 'Yes' else 'No' end as listed, strftime(timestamp '2026-09-07 09:05:00' + to_minutes(c_custkey::int), '%Y-%m-%dT%H:%M:%S.000Z') as iso from customer")
def displays(spark, d):
    """PRJ13, FN-T14, FN-S14: cells and dates as lists show them."""
    c = contacts(spark, d).withColumn("listed", F.col("birthday") != "")
    at = (F.lit("2026-09-07 09:05:00").cast("timestamp") + F.make_dt_interval(mins=F.col("idx").cast("int"))).alias("at")
    return c.select("idx", rows.displayed(c, "organization").alias("organization"), rows.displayed(c, "listed").alias("listed"), TM.date_shown(at).alias("iso"))


@query("""
with n as (select count(*) as events, count(*) filter (event_id % 7 <> 0) as included from events), f as (select count(*) as sources from (select distinct user_id, event_id // 10000 from events))
select 'sources' as what, sources::varchar as value from f union all select 'events', events::varchar from n union all select 'included', included::varchar from n union all select 'definitions', '0' union all select 'malformed', '0'
union all select 'version', '2.0' union all select 'calscale', 'GREGORIAN' union all select 'method', '' union all select 'name', 'Merged calendar' union all select 'warnings', ''
""")
def merge_analysis(spark, d):
    """TG12, AGG5, AGG6: calendars merged from their files, some events left out; candidates among them are in event_dup_exact_order."""
    files = _calendars(spark, d).drop("source_index")
    # names alone are ranked, not the texts beside them
    names = ranked(files.select("source_file"), "source_file").select("source_file", (F.col("rank") - 1).cast("int").alias("source_index"))
    files = stored(files.join(names, "source_file"))
    own = F.get(named(F.col("raw_properties"), "X-IDX"), F.lit(0))["value"].cast("long")
    m = calendar_merge.analyze(files, lambda events: events.where(own % 7 == 0).select("idx"))
    row = lambda c: F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value"))
    counts = m.summary.select(F.explode(F.array(*map(row, ["sources", "events", "included", "definitions", "malformed"]))).alias("x"))
    said = m.metadata.withColumn("warnings", F.array_join("warnings", ",")).select(F.explode(F.array(*map(row, ["version", "calscale", "method", "name", "warnings"]))).alias("x"))
    return counts.unionByName(said).select("x.what", "x.value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
