"""Events and contacts made from the driver's tables, for the queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import TIME, typed, zone_label


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{d}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt to all cores, and to eight tasks for each split of a large file: a file may hold them in one group, which is one task's.

    With `by`, those of equal values go to one task, and tasks are no fewer than a shuffle's, as a grouping by them takes place there.

    They are counted on their way, below which Spark moves no condition: one on
    a derived column would be worked out where few tasks read the file.
    """
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    tasks = cores if splits < cores else 8 * splits
    if by:
        tasks = max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *by).observe(f"dealt-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss")


def calendar_events(spark: SparkSession, d: str, **by: F.Column) -> DataFrame:
    """The events table as calendar events: by event_id % 4 utc, in New York, floating, whole days.

    `by` names columns of the table that are kept, rows being dealt by their values.
    """
    e = dealt(table(spark, d, "events").withColumns(by), *by)
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(stamp("ts"), F.lit("Z"))).when(kind == 3, F.date_format("ts", "yyyyMMdd")).otherwise(stamp("ts"))
    later = F.col("ts") + F.expr("interval '1' hour")
    raw_end = F.when(kind == 0, F.concat(F.date_format(later, "yyyyMMdd'T'HHmmss"), F.lit("Z"))).when(kind != 3, F.date_format(later, "yyyyMMdd'T'HHmmss"))
    tz = F.when(kind == 1, "America/New_York").otherwise("")
    none = F.lit(None).cast(TIME)
    # formatted here, as a time mentions its text often
    e = e.select("event_id", "user_id", "event_type", "props", *(c for c in by if c != "user_id"), raw.alias("raw"), raw_end.alias("raw_end"))
    rows = e.select("*", typed(F.col("raw"), tz, kind == 3).alias("start_time"), F.when(F.col("raw_end").isNotNull(), typed(F.col("raw_end"), tz, F.lit(False))).alias("end_time")).drop("raw", "raw_end")
    empty = F.lit("")
    return rows.select(
        *by, F.col("event_id").alias("idx"), F.lit(0).alias("source_index"), F.col("event_id").cast("int").alias("event_index"), F.lit("events.ics").alias("source_file"),
        F.concat(F.lit("uid-"), F.col("event_id") % 997).alias("uid"), F.col("event_type").alias("title"), F.col("props").alias("description"), F.concat(F.lit("Room "), F.col("user_id") % 50).alias("location"),
        F.col("start_time.value").alias("start"), F.coalesce("end_time.value", empty).alias("end"), "start_time", "end_time", empty.alias("duration"), (F.col("start_time.kind") == "date").alias("all_day"),
        zone_label(F.col("start_time")).alias("timezone"), F.col("start_time.kind").alias("time_kind"), F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("organizer"), F.array(F.lit("a@example.com"), F.concat(F.lit("b"), F.col("user_id"), F.lit("@example.com"))).alias("attendees"),
        F.lit("CONFIRMED").alias("status"), F.when(F.col("event_id") % 5 == 0, "FREQ=WEEKLY;COUNT=4").otherwise("").alias("rrule"), F.array().cast(f"array<{TIME}>").alias("rdates"), F.array().cast(f"array<{TIME}>").alias("exdates"),
        none.alias("recurrence_id"), F.lit(None).cast("int").alias("sequence"), none.alias("created"), none.alias("last_modified"), none.alias("dtstamp"), F.array("event_type").alias("categories"), empty.alias("url"), empty.alias("geo"),
        F.array().cast("array<struct<group:string,name:string,value:string,parameters:map<string,array<string>>,raw:string>>").alias("raw_properties"), empty.alias("raw"),
    )


def recurring_events(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth event as a weekly series of four, its follower as an override of the second occurrence, every other one cancelled.

    A series' times are of one kind, by its master's id as in calendar_events.
    """
    e = table(spark, d, "events").where("event_id % 5 <= 1").select("event_id", "event_type", F.date_trunc("second", "ts").alias("ts"), (F.col("event_id") - F.col("event_id") % 5).alias("m"))
    first = e.where("event_id % 5 = 0").select("m", F.col("ts").alias("first"))
    # only one side is dealt: the times, which cost most, are made of its rows
    rows = dealt(e).join(first, "m", "left").withColumn("kind", F.col("m") % 4)
    kind = F.col("kind")
    basic = lambda c: F.when(kind == 0, F.concat(F.date_format(c, "yyyyMMdd'T'HHmmss"), F.lit("Z"))).when(kind == 3, F.date_format(c, "yyyyMMdd")).otherwise(F.date_format(c, "yyyyMMdd'T'HHmmss"))
    tz, none = F.when(kind == 1, "America/New_York").otherwise(""), F.lit(None).cast(TIME)
    master = F.col("event_id") % 5 == 0
    return rows.select(
        F.col("event_id").alias("idx"), F.concat(F.lit("series-"), "m").alias("uid"), F.col("event_type").alias("title"), F.lit("").alias("location"), F.lit("events.ics").alias("source_file"),
        typed(basic(F.col("ts")), tz, kind == 3).alias("start_time"), none.alias("end_time"), F.lit("").alias("duration"), F.when(F.col("event_id") % 10 == 1, "CANCELLED").otherwise("CONFIRMED").alias("status"),
        F.when(master, "FREQ=WEEKLY;COUNT=4").otherwise("").alias("rrule"), F.array().cast(f"array<{TIME}>").alias("rdates"), F.array().cast(f"array<{TIME}>").alias("exdates"),
        F.when(~master, typed(basic(F.col("first") + F.expr("interval '7' day")), tz, kind == 3)).alias("recurrence_id"), F.lit("").alias("recurrence_range"),
    )


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """The customer table as contacts; mail, phone and names repeat by key so that there are duplicates."""
    c = dealt(table(spark, d, "customer"))
    k = F.col("c_custkey")
    typed_ = "struct<value:string,types:array<string>,preference:int,parameters:map<string,array<string>>>"
    one = lambda v, t, p="null": F.struct(v.alias("value"), F.array(F.lit(t)).alias("types"), F.expr(f"cast({p} as int)").alias("preference"), F.expr("cast(map() as map<string,array<string>>)").alias("parameters")).cast(typed_)
    street = F.concat(F.lit("Street "), k % 900)
    address = F.struct(
        street.alias("value"), F.array(F.lit("home")).alias("types"), F.lit(None).cast("int").alias("preference"), F.expr("cast(map() as map<string,array<string>>)").alias("parameters"), F.lit("").alias("po_box"), F.lit("").alias("extended"),
        street.alias("street"), F.concat(F.lit("Town "), F.col("c_nationkey")).alias("locality"), F.lit("").alias("region"), F.lit("").alias("postal_code"), F.lit("").alias("country"), street.alias("formatted"),
    )
    empty, words = F.lit(""), F.array().cast("array<string>")
    media = F.lit(None).cast("struct<kind:string>")
    return c.select(
        k.alias("idx"), F.concat(F.lit("0:"), k, F.lit(":"), "c_name").alias("id"), F.lit(0).alias("source_index"), k.cast("int").alias("original_index"), F.lit("3.0").alias("version"), F.col("c_name").alias("formatted_name"),
        F.concat(F.lit("Given"), k % 83).alias("given_name"), words.alias("additional_names"), F.concat(F.lit("Family"), k % 71).alias("family_name"), words.alias("honorific_prefixes"), words.alias("honorific_suffixes"),
        F.col("c_mktsegment").alias("organization"), words.alias("organization_units"), F.when(k % 3 == 0, "Buyer").otherwise("").alias("title"), empty.alias("role"),
        F.when(k % 4 == 0, F.array().cast(f"array<{typed_}>")).otherwise(F.array(one(F.concat(F.lit("User"), k % 1300, F.lit("@Example.com")), "home"))).alias("emails"),
        F.array(one(F.concat(F.lit("+1 (555) 010-"), F.lpad((k % 1100).cast("string"), 4, "0")), "cell")).alias("phones"), F.array(address).alias("addresses"), F.array().cast("array<struct<value:string,types:array<string>,preference:int,parameters:map<string,array<string>>,safe_protocol:boolean>>").alias("urls"),
        F.when(k % 5 == 0, F.concat(F.lit("19"), F.lpad((k % 97).cast("string"), 2, "0"), F.lit("-01-01"))).otherwise("").alias("birthday"), empty.alias("anniversary"), words.alias("categories"), F.when(k % 7 == 0, F.array(F.concat(F.lit("=note "), k))).otherwise(words).alias("notes"),
        empty.alias("nickname"), empty.alias("gender"), F.when(k % 6 == 0, F.concat(F.lit("uid-"), k % 1200)).otherwise("").alias("uid"), empty.alias("kind"), media.alias("photo"), media.alias("logo"), empty.alias("geo"), empty.alias("timezone"), F.lit("customer.vcf").alias("source_file"), F.array().cast("array<struct<group:string,name:string,value:string,parameters:map<string,array<string>>,raw:string>>").alias("raw_properties"),
    )


def series(spark: SparkSession, d: str, rule: str) -> DataFrame:
    """Orders as recurring events that start at their date."""
    o = dealt(table(spark, d, "orders"))
    return o.select(F.col("o_orderkey").cast("string").alias("series_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("dtstart"), F.lit(rule).alias("rrule"))
