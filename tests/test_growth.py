"""What made queries grow faster than their tables: work done again at each mention, or below a deal."""

import time
import unicodedata

from pyspark.sql import functions as F

from kalends.functions.text import nfkc
from kalends.functions.time import wall_instant
from kalends.operators.contact_merge import unite
from kalends.operators.recurrence import is_simple, rule_code, work_estimate
from kalends.operators.search import domain
from kalends.plans.queries import QUERIES
from kalends.plans.tables import dealt, recurring_events


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conditions_on_derived_columns_stay_above_a_deal(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    rows = dealt(spark.read.parquet(str(tmp_path / "t"))).select(F.sha2(F.col("id").cast("string"), 256).alias("x"))
    text = plan(rows.where("x <> ''"))
    assert "sha2" in text and "sha2" not in text[text.index("Repartition"):]
    assert [r.position for r in domain(rows, "x").orderBy("value").collect()] == list(range(100))


def test_a_domain_leaves_out_empty_values(spark):
    rows = spark.createDataFrame([("b",), ("",), (None,), ("a",), ("b",)], "x string")
    assert sorted((r.value, r.position) for r in domain(rows, "x").collect()) == [("a", 0), ("b", 1)]


def test_united_values_are_normalised_once(spark):
    n = 1500
    item = "struct<value:string,types:array<string>,preference:int,parameters:map<string,array<string>>>"
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.concat(F.lit("User"), k % 700).alias("value"), F.array(F.concat(F.lit("t"), (k >= 700).cast("int"))).alias("types"), F.lit(None).cast("int").alias("preference"), F.expr("cast(map() as map<string,array<string>>)").alias("parameters")).cast(item)).alias("v"))
    key = lambda v, form: F.lower(F.trim(F.regexp_replace(form(v), r"\s+", " ")))
    start = time.perf_counter()
    (row,) = rows.select(unite(F.col("v"), F.col("v")["value"], key).alias("u")).collect()
    assert [x.value for x in row.u] == [f"User{k}" for k in range(700)] and all(x.types == ["t0", "t1"] for x in row.u)
    assert time.perf_counter() - start < 30


def test_scopes_make_times_once(spark):
    df = QUERIES["tz_scopes"](spark, "/root/testdata/sf0.001")
    assert "from_utc_timestamp" not in plan(df) and df.count() == 4


def test_rules_and_times_are_taken_apart_once(spark):
    rows = spark.createDataFrame([("FREQ=DAILY", "2024-03-10 12:00:00", "America/New_York")], "r string, w string, z string")
    for c in (rule_code(F.col("r")), is_simple(F.col("r")), work_estimate(F.col("r"), F.lit(10), F.lit(0))):
        assert plan(rows.select(c.alias("c"))).count("str_to_map") == 1
    text = plan(rows.select(wall_instant(F.col("w").cast("timestamp_ntz"), F.col("z")).alias("c")))
    assert text.count("Africa/Abidjan") == 1


def test_recurring_events_are_made_by_all_cores(spark):
    """The tasks that read the file made them, one for a row group."""
    rows = recurring_events(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id % 5 <= 1").count()


def test_a_value_is_worked_out_once_before_nfkc(spark):
    """What was normalised was extracted again above the UDF, from texts carried through it."""
    df = QUERIES["phone_email_normalize"](spark, "/root/testdata/sf0.001")
    above, below = plan(df).split("ArrowEvalPython")[0], plan(df).split("ArrowEvalPython")[-1]
    assert "regexp_extract(text" not in above and "regexp_extract(text" in below
    odd = ["", None, "plain\n", "a\u0085", "b\u2028", "\uff21\uff22", " \ufb01x ", "caf\u00e9\u2460"]
    got = spark.createDataFrame([(x,) for x in odd], "x string").select(nfkc(F.col("x"))).collect()
    assert [r[0] for r in got] == [x and unicodedata.normalize("NFKC", x) for x in odd]
