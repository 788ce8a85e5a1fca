"""Recurrence: series, rule expansion, exclusions, additions and overrides.

Rules are evaluated on wall clocks, by DataFrame functions. Rules of equal steps
are sequences from the first step in range. Others are taken apart into days,
times of the day and choices of a period, for the periods that meet the range
alone, however long ago the series began. Exclusions are an anti-join, overrides an outer
join, and the same time from several sources counts once: the master's before
the rule's before an addition's.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.bind import let
from ..functions.time import is_supported_zone
from .search import running_total

#: Rule parts that are evaluated: fixed values of the format.
PARTS = ["FREQ", "INTERVAL", "COUNT", "UNTIL", "BYSECOND", "BYMINUTE", "BYHOUR", "BYDAY", "BYMONTHDAY", "BYYEARDAY", "BYWEEKNO", "BYMONTH", "BYSETPOS", "WKST"]
PERIODS = {"SECONDLY": 1, "MINUTELY": 60, "HOURLY": 3600, "DAILY": 86_400, "WEEKLY": 604_800, "MONTHLY": 2_678_400, "YEARLY": 31_622_400}


def rule_map(rrule: Column) -> Column:
    """A rule's parts by upper-case name."""
    return F.str_to_map(F.upper(F.regexp_replace(rrule, r"^RRULE:|\s", "")), F.lit(";"), F.lit("="))


#: What a part's values must be: lists of whole numbers between bounds, of weekdays, one number, or one word.
NUMBERED = {"BYSECOND": (0, 60), "BYMINUTE": (0, 59), "BYHOUR": (0, 23), "BYMONTHDAY": (-31, 31), "BYYEARDAY": (-366, 366), "BYWEEKNO": (-53, 53), "BYMONTH": (1, 12), "BYSETPOS": (-366, 366)}
DAYS = r"(?:MO|TU|WE|TH|FR|SA|SU)"
PATTERNS = {"INTERVAL": r"0*[1-9]\d{0,8}", "COUNT": r"0*[1-9]\d{0,8}", "UNTIL": r"\d{8}(?:T\d{6}Z?)?", "WKST": DAYS, "BYDAY": rf"(?:[+-]?\d{{1,2}})?{DAYS}(?:,(?:[+-]?\d{{1,2}})?{DAYS})*"}


def _within(low: int, high: int) -> Callable[[Column], Column]:
    """Whether a text is a whole number between two bounds, which is not 0 if it may be negative."""
    return lambda v: F.coalesce(v.try_cast("int").between(low, high) & ((v.try_cast("int") != 0) | F.lit(low >= 0)), F.lit(False))


def rule_code(rrule: Column) -> Column:
    """INVALID_RRULE for a rule that can't be read, UNSUPPORTED_RRULE_PART for one with other parts, null else."""
    def code(m: Column) -> Column:
        fine = F.coalesce(m["FREQ"].isin(list(PERIODS)), F.lit(False))
        for name, pattern in PATTERNS.items():
            fine = fine & F.coalesce(m[name].rlike(f"^(?:{pattern})$"), ~F.map_contains_key(m, F.lit(name)))
        for name, (low, high) in NUMBERED.items():
            fine = fine & F.coalesce(F.forall(F.split(m[name], ","), _within(low, high)), ~F.map_contains_key(m, F.lit(name)))
        return F.when(F.size(_other_parts(m)) > 0, F.lit("UNSUPPORTED_RRULE_PART")).when(~fine, F.lit("INVALID_RRULE"))

    # bound, as Spark would take the rule apart again at each mention
    return F.when(F.coalesce(rrule, F.lit("")) != "", let(rule_map(rrule), code))


def unsupported_parts(rrule: Column) -> Column:
    return _other_parts(rule_map(rrule))


def _other_parts(m: Column) -> Column:
    return F.array_except(F.filter(F.map_keys(m), lambda k: k != ""), F.array(*map(F.lit, PARTS)))


def work_estimate(rrule: Column, days: Column, additions: Column) -> Column:
    """About how many occurrences a series can have in a range of days."""
    def estimate(m: Column) -> Column:
        freq, whole = m["FREQ"], lambda name, least: F.greatest(F.lit(least), F.coalesce(F.try_to_number(m[name], F.lit("99999999")).cast("long"), F.lit(least)))
        seconds = F.greatest(F.lit(1), days * 86_400)
        period = F.lit(86_400)
        for name, size in PERIODS.items():
            period = F.when(freq == name, F.lit(size if size < 700_000 else {"MONTHLY": 2_592_000, "YEARLY": 31_536_000}[name])).otherwise(period)
        base = seconds / period / whole("INTERVAL", 1)
        base = F.when(freq == "MONTHLY", base * 5).when(freq == "YEARLY", base * 366).otherwise(base)
        for part in ("BYHOUR", "BYMINUTE", "BYSECOND"):
            base = base * F.greatest(F.lit(1), F.when(m[part].isNull(), F.lit(0)).otherwise(F.size(F.split(m[part], ","))))
        count = F.coalesce(F.try_to_number(m["COUNT"], F.lit("99999999")).cast("long"), F.lit(2**62))
        return F.least(count, F.ceil(base)) + additions

    return F.when(F.coalesce(rrule, F.lit("")) == "", additions + 1).otherwise(let(rule_map(rrule), estimate))


def is_simple(rrule: Column) -> Column:
    """A rule of equal steps: INTERVAL, COUNT and UNTIL alone, and no months or years."""
    equal = lambda m: m["FREQ"].isin([f for f in PERIODS if f not in ("MONTHLY", "YEARLY")]) & (F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, ["FREQ", "INTERVAL", "COUNT", "UNTIL", "WKST"])))) == 0)
    return let(rule_map(rrule), equal)


def until_of(m: Column, tzid: Column | None = None) -> Column:
    """UNTIL on the series' wall clock; a date is its last second, and an instant is shown in the series' zone if it has one."""
    u = F.regexp_replace(m["UNTIL"], "Z$", "")
    text = F.when(F.length(u) == 8, F.concat(u, F.lit("T235959"))).otherwise(u)
    wall = F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss"))
    if tzid is not None:
        known = is_supported_zone(tzid)
        wall = F.when(m["UNTIL"].endswith("Z") & known, F.from_utc_timestamp(wall, F.when(known, tzid).otherwise("UTC"))).otherwise(wall)
    return wall.cast("timestamp_ntz")


def zone_of(series: DataFrame) -> Column:
    return F.col("tzid") if "tzid" in series.columns else F.lit(None).cast("string")


def seconds(at: Column) -> Column:
    """A wall time as seconds of its own clock."""
    return F.unix_seconds(at.cast("timestamp"))


def wall_at(at: Column) -> Column:
    return F.timestamp_seconds(at).cast("timestamp_ntz")


def expand_simple(series: DataFrame, start: str, end: str) -> DataFrame:
    """(series_id, start TIMESTAMP_NTZ) of simple rules in [start 00:00:00, end 23:59:59]; the sequence begins at the first step inside."""
    series, m = series.withColumn("_m", rule_map(F.col("rrule"))), F.col("_m")
    unit = F.create_map(*(F.lit(x) for f, n in PERIODS.items() for x in (f, n)))[m["FREQ"]]
    step = (unit * F.coalesce(m["INTERVAL"].try_cast("long"), F.lit(1))).cast("long")
    lo, hi = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in (f"{start} 00:00:00", f"{end} 23:59:59"))
    rows = series.select("series_id", seconds(F.col("dtstart")).alias("at"), step.alias("step"), m["COUNT"].try_cast("long").alias("n"), seconds(until_of(m, zone_of(series))).alias("until"))
    first = F.greatest(F.lit(0), F.ceil((lo - F.col("at")) / F.col("step")))
    steps = F.floor((F.least(hi, F.coalesce("until", hi)) - F.col("at")) / F.col("step"))
    last = F.when(F.col("n").isNotNull(), F.least(steps, F.col("n") - 1)).otherwise(steps)
    rows = rows.withColumn("first", first).withColumn("last", last).where("first <= last")
    return rows.select("series_id", "at", "step", F.explode(F.sequence("first", "last")).alias("k")).select("series_id", wall_at(F.col("at") + F.col("k") * F.col("step")).alias("start"))


# Other rules are days that pass all of a rule's parts, times of the day, and choices among a period's occurrences.
# Only the periods that meet the range are looked at; with COUNT, those since the start.
# A day is its number since 1970-01-01, a weekday 0 for Monday to 6, a time of day its seconds.


def rule_parts(series: DataFrame) -> DataFrame:
    """series_id and a rule's parts as columns: lists are arrays of int, weekdays those of any week (`wdays`) or n * 7 + weekday of the n-th (`nth`)."""
    series, m = series.withColumn("_m", rule_map(F.col("rrule"))), F.col("_m")
    numbers = lambda name: F.coalesce(F.array_sort(F.array_distinct(F.split(m[name], ",").cast("array<int>"))), F.expr("cast(array() as array<int>)"))
    weekday = lambda d: F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.right(d, F.lit(2))).cast("int") - 1
    nth = lambda d: F.coalesce(F.regexp_extract(d, r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    days = F.coalesce(F.split(m["BYDAY"], ","), F.expr("cast(array() as array<string>)"))
    freq, at = m["FREQ"], F.col("dtstart")
    long_period = freq.isin("MONTHLY", "YEARLY")
    none = F.expr("cast(array() as array<int>)")
    undated = (F.size(numbers("BYWEEKNO")) == 0) & (F.size(numbers("BYYEARDAY")) == 0) & (F.size(numbers("BYMONTHDAY")) == 0) & (F.size(days) == 0)
    # what isn't stated follows the start
    given = lambda c, when, value: F.when((F.size(c) == 0) & when, F.array(value)).otherwise(c)
    plain = F.transform(F.filter(days, lambda d: (nth(d) == 0) | ~long_period), weekday)
    finer = list(PERIODS)
    day = F.unix_date(at.cast("date"))
    return series.select(
        "series_id", freq.alias("freq"), F.coalesce(m["INTERVAL"].try_cast("long"), F.lit(1)).cast("long").alias("interval"), m["COUNT"].try_cast("long").alias("count"), seconds(until_of(m, zone_of(series))).alias("until"),
        seconds(at).alias("from"), day.alias("day0"), F.coalesce(weekday(m["WKST"]), F.lit(0)).alias("wkst"),
        given(numbers("BYMONTH"), undated & (freq == "YEARLY"), F.month(at.cast("date"))).alias("months"), numbers("BYWEEKNO").alias("weeks"), numbers("BYYEARDAY").alias("ydays"),
        given(numbers("BYMONTHDAY"), undated & long_period, F.dayofmonth(at.cast("date"))).alias("mdays"),
        F.when(undated & (freq == "WEEKLY"), F.array(F.pmod(day + 3, F.lit(7)))).otherwise(F.coalesce(plain, none)).alias("wdays"),
        F.coalesce(F.transform(F.filter(days, lambda d: (nth(d) != 0) & long_period), lambda d: nth(d) * 7 + weekday(d)), none).alias("nth"),
        given(numbers("BYHOUR"), ~freq.isin(finer[:3]), F.hour(at.cast("timestamp"))).alias("hours"), given(numbers("BYMINUTE"), ~freq.isin(finer[:2]), F.minute(at.cast("timestamp"))).alias("minutes"),
        given(numbers("BYSECOND"), freq != "SECONDLY", F.second(at.cast("timestamp"))).alias("seconds"), numbers("BYSETPOS").alias("places"),
    )


def day_of(year: Column, month: Column | int, day: Column | int) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.unix_date(F.make_date(year.cast("int"), as_column(month).cast("int"), as_column(day).cast("int")))


def passes(day: Column) -> Column:
    """Whether a day passes the parts of its row's rule that speak of days."""
    date = F.date_from_unix_date(day)
    year, month, weekday = F.year(date), F.month(date), F.pmod(day + 3, F.lit(7))
    m, length = F.dayofmonth(date), F.dayofmonth(F.last_day(date))
    y, year_length = F.dayofyear(date), F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    among = lambda name, *values: (F.size(name) == 0) | functools.reduce(lambda a, b: a | b, (F.array_contains(F.col(name), v) for v in values))
    by_month = (F.col("freq") == "MONTHLY") | (F.size("months") > 0)
    at, of = F.when(by_month, m).otherwise(y), F.when(by_month, length).otherwise(year_length)
    code = lambda n: (n * 7 + weekday).cast("int")
    nth = among("nth", code(F.floor((at - 1) / 7) + 1), code(-F.floor((of - at) / 7) - 1))
    # a week belongs to the year that holds its fourth day
    fourth = F.date_from_unix_date((day - F.pmod(weekday - F.col("wkst"), F.lit(7)) + 3).cast("int"))
    week = lambda d: (F.floor((F.dayofyear(d) - 1) / 7) + 1).cast("int")
    late = F.unix_date(F.make_date(F.year(fourth), F.lit(12), F.lit(28)))
    weeks = week(F.date_from_unix_date((late - F.pmod(F.pmod(late + 3, F.lit(7)) - F.col("wkst"), F.lit(7)) + 3).cast("int")))
    numbered = (F.size("weeks") == 0) | F.array_contains(F.col("weeks"), week(fourth)) | (F.array_contains(F.col("weeks"), week(fourth) - weeks - 1) & (F.year(fourth) <= year))
    return among("months", month) & among("wdays", weekday) & nth & among("mdays", m, m - length - 1) & among("ydays", y, y - year_length - 1) & numbered


def period_of(day: Column) -> Column:
    """The number of a day's period: year, month, week or day."""
    date, freq = F.date_from_unix_date(day.cast("int")), F.col("freq")
    return F.when(freq == "YEARLY", F.year(date)).when(freq == "MONTHLY", F.year(date) * 12 + F.month(date) - 1).when(freq == "WEEKLY", F.floor((day + 3 - F.col("wkst")) / 7)).otherwise(day).cast("long")


def period_days(low: Column, high: Column) -> Column:
    """The days of the row's period from low to high that may pass, in no order: those of BYMONTHDAY, or all."""
    p, freq = F.col("period"), F.col("freq")
    first = F.when(freq == "YEARLY", day_of(p, 1, 1)).when(freq == "MONTHLY", day_of(F.floor(p / 12), F.pmod(p, F.lit(12)) + 1, 1)).when(freq == "WEEKLY", p * 7 - 3 + F.col("wkst")).otherwise(p).cast("int")
    last = F.when(freq == "YEARLY", day_of(p, 12, 31)).when(freq == "MONTHLY", F.unix_date(F.last_day(F.date_from_unix_date(first)))).when(freq == "WEEKLY", first + 6).otherwise(first).cast("int")
    months = F.when(freq == "MONTHLY", F.array(p)).otherwise(F.transform(F.when(F.size("months") > 0, F.col("months")).otherwise(F.sequence(F.lit(1), F.lit(12))), lambda k: p * 12 + k - 1))

    def dated(k: Column) -> Column:
        begin = day_of(F.floor(k / 12), F.pmod(k, F.lit(12)) + 1, 1)
        return let(begin, lambda b: let(F.unix_date(F.last_day(F.date_from_unix_date(b))), lambda e: F.filter(F.transform(F.col("mdays"), lambda n: F.when(n > 0, b + n - 1).otherwise(e + n + 1)), lambda d: d.between(b, e))))

    by_date = freq.isin("MONTHLY", "YEARLY") & (F.size("mdays") > 0)
    low, high = F.greatest(first, low.cast("int")), F.least(last, high.cast("int"))
    every = F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.when(by_date, F.filter(F.array_distinct(F.flatten(F.transform(months, dated))), lambda d: d.between(low, high))).otherwise(every)


def chosen(values: Column) -> Column:
    """Those of a period's values, in order, that BYSETPOS names; all without it."""
    place = lambda v: F.transform(F.col("places"), lambda n: F.get(v, F.when(n > 0, n - 1).otherwise(F.size(v) + n)))
    return let(values, lambda v: F.when(F.size("places") > 0, F.array_sort(F.array_distinct(F.filter(place(v), lambda x: x.isNotNull())))).otherwise(v))


def product(*lists: tuple[Column, int]) -> Column:
    """Sums of one value of each list times its weight, in the lists' order."""
    values, weight = lists[0]
    own = F.transform(values, lambda x: x * weight)
    if len(lists) == 1:
        return own
    rest = product(*lists[1:])
    return F.flatten(F.transform(own, lambda x: F.transform(rest, lambda y: x + y)))


def day_times(day: Column) -> Column:
    """The times of a day that passes: those of the rule, or the steps of a period under a day that fall on it."""
    unlimited = lambda name, n: F.when(F.size(name) > 0, F.col(name)).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))
    hours, minutes = unlimited("hours", 24), unlimited("minutes", 60)
    start = F.col("from")

    def steps(units: Column, size: int) -> Column:
        """Periods of a day in units of `size` seconds that lie whole intervals after the start's."""
        zero = day.cast("long") * (86_400 // size) - F.floor(start / size)
        return F.filter(units, lambda u: F.pmod(u + zero, F.col("interval")) == 0)

    def hourly() -> Column:
        # of all hours, only those in step are made
        first = F.pmod(F.floor(start / 3600) - day.cast("long") * 24, F.col("interval")).cast("int")
        in_step = F.when(first < 24, F.sequence(first, F.lit(23), F.least("interval", F.lit(24)).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.when(F.size("hours") > 0, steps(F.col("hours"), 3600)).otherwise(in_step)

    times = lambda units, size, rest: F.flatten(F.transform(units, lambda u: F.transform(rest, lambda r: u * size + r)))
    short = lambda units, size, rest: times(steps(units, size), size, rest)
    whole = product((F.col("hours"), 3600), (F.col("minutes"), 60), (F.col("seconds"), 1))
    freq = F.col("freq")
    return (
        F.when(freq == "HOURLY", times(hourly(), 3600, chosen(product((F.col("minutes"), 60), (F.col("seconds"), 1)))))
        .when(freq == "MINUTELY", short(product((hours, 60), (minutes, 1)), 60, chosen(F.col("seconds"))))
        .when(freq == "SECONDLY", short(product((hours, 3600), (minutes, 60), (unlimited("seconds", 60), 1)), 1, chosen(F.array(F.lit(0)))))
        .when(freq == "DAILY", chosen(whole)).otherwise(whole)
    )


def expand_parts(rules: DataFrame, start: str, end: str) -> DataFrame:
    """(series_id, at, count) of `rule_parts` rows: their occurrences from the start on, or in a range if there is no COUNT."""
    low, high = (F.unix_date(F.lit(x).cast("date")) for x in (start, end))
    since = F.when(F.col("count").isNull(), F.greatest("day0", low)).otherwise(F.col("day0"))
    till = F.least(high, F.coalesce(F.floor(F.col("until") / 86_400), high)).cast("int")
    own = rules.withColumn("low", since).withColumn("high", till).where("low <= high").withColumn("period0", period_of(F.col("day0")))
    step = F.when(F.col("freq").isin("YEARLY", "MONTHLY", "WEEKLY", "DAILY"), F.col("interval")).otherwise(F.lit(1).cast("long"))
    first = F.col("period0") + F.ceil((period_of(F.col("low")) - F.col("period0")) / step) * step
    own = own.withColumn("first", first.cast("long")).withColumn("last", period_of(F.col("high"))).where("first <= last")
    # a period that is a day of another weekday gets no row
    weekly = (F.size("wdays") > 0) & ~F.col("freq").isin("YEARLY", "MONTHLY", "WEEKLY")
    every = F.sequence(F.col("first"), F.col("last"), step)
    periods = F.when(weekly, F.filter(every, lambda p: F.array_contains("wdays", F.pmod(p + 3, F.lit(7)).cast("int")))).otherwise(every)
    own = own.select("*", F.explode(periods).alias("period"))
    # a set is chosen from a whole period, which has one row; a week begins with the start's own day, if that is in it
    sets = (F.size("places") > 0) & F.col("freq").isin("YEARLY", "MONTHLY", "WEEKLY")
    days = F.when(sets, F.array(F.lit(None).cast("int"))).otherwise(period_days(F.col("low"), F.col("high")))
    own = own.select("*", F.explode(days).alias("day")).where(sets | passes(F.col("day")))
    begin = F.when(F.col("freq") == "WEEKLY", F.col("day0")).otherwise(F.lit(-(2**30)))
    among = F.array_sort(F.filter(period_days(begin, F.lit(2**30)), passes))
    stamps = let(day_times(F.col("day0")), lambda t: F.flatten(F.transform(among, lambda d: F.transform(t, lambda x: d.cast("long") * 86_400 + x))))
    times = F.when(sets, chosen(stamps)).otherwise(F.transform(day_times(F.col("day")), lambda x: F.col("day").cast("long") * 86_400 + x))
    every = own.select("series_id", "count", "from", "until", F.explode(times).alias("at"))
    return every.where("at >= from and (until is null or at <= until)").select("series_id", "at", "count")


def expand_any(series: DataFrame, start: str, end: str) -> DataFrame:
    """(series_id, start TIMESTAMP_NTZ) of all other rules.

    Occurrences are ranked within their series for COUNT's sake. Rules are dealt
    by series before they are expanded, being far fewer than their occurrences.
    Of series of several rows one may hold most: those rows go to any task, and
    their occurrences are dealt by series.
    """
    spark = series.sparkSession
    low, high = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in (f"{start} 00:00:00", f"{end} 23:59:59"))
    # a number is given, as rules are few bytes and Spark would join them to few tasks
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    of_series = Window.partitionBy("series_id")
    told = series.repartition(2 * tasks, "series_id").withColumn("_rows", F.count(F.lit(1)).over(of_series))
    # dealt anew, so that no task sorts both rules and occurrences; to another number, as Spark leaves out a deal that changes nothing
    dealt = told.where("_rows = 1").repartition(tasks, "series_id"), told.where("_rows > 1").repartition(tasks)
    rank = F.row_number().over(of_series.orderBy("at"))
    single, several = (expand_parts(rule_parts(x), start, end).withColumn("rank", rank) for x in dealt)
    return single.unionByName(several).where((F.col("count").isNull() | (F.col("rank") <= F.col("count"))) & F.col("at").between(low, high)).select("series_id", wall_at(F.col("at")).alias("start"))


def days_of(start: str, end: str) -> int:
    days = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1
    if not 0 < days <= LIMITS.range_days:
        raise ValueError(f"a range has 1 to {LIMITS.range_days} days, its end not before its start")
    return days


def expansion_codes(series: DataFrame, start: str, end: str, limit: int = LIMITS.series_occurrences) -> DataFrame:
    """(series_id, code) of the rules that `expand_rules` doesn't expand: rule_code, or RECURRENCE_LIMIT_REACHED."""
    over = work_estimate(F.col("rrule"), F.lit(days_of(start, end)), F.lit(0)) > 4 * limit
    code = F.coalesce(rule_code(F.col("rrule")), F.when((F.coalesce("rrule", F.lit("")) != "") & over, F.lit("RECURRENCE_LIMIT_REACHED")))
    return series.select("series_id", code.alias("code")).where("code is not null")


def expand_rules(series: DataFrame, start: str, end: str, limit: int = LIMITS.series_occurrences) -> DataFrame:
    """Occurrence starts of (series_id, dtstart TIMESTAMP_NTZ, rrule) rows, and tzid if they have one, in a range of days.

    Rules that can't be read, have unsupported parts, or could have more than
    four times the limit, have none; `expansion_codes` tells of them.
    """
    # the cheapest condition first: series that begin after the range
    begun = F.col("dtstart").isNull() | (F.to_date("dtstart") <= F.lit(end).cast("date"))
    own = series.where(begun).where(F.coalesce("rrule", F.lit("")) != "").where(rule_code(F.col("rrule")).isNull())
    own = own.where(work_estimate(F.col("rrule"), F.lit(days_of(start, end)), F.lit(0)) <= 4 * limit)
    return expand_simple(own.where(is_simple(F.col("rrule"))), start, end).unionByName(expand_any(own.where(~is_simple(F.col("rrule"))), start, end))


def combine(masters: DataFrame, generated: DataFrame, additions: DataFrame, exclusions: DataFrame, start: str, end: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, start, source) of all sources in range, each time once and exclusions left out.

    All inputs have the keys and start TIMESTAMP_NTZ.
    """
    by = [*keys, "start"]
    tagged = [df.select(*by, F.lit(k).alias("priority")) for k, df in enumerate((masters, generated, additions))]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).where(F.to_date("start").between(start, end))
    once = every.groupBy(*by).agg(F.min("priority").alias("priority"))
    kept = once.join(exclusions.select(*by).distinct(), by, "left_anti")
    return kept.select(*by, F.get(F.array(F.lit("master"), F.lit("rrule"), F.lit("rdate")), "priority").alias("source"))


def override(occurrences: DataFrame, overrides: DataFrame, start: str, end: str) -> DataFrame:
    """Occurrences with their overrides, (series_id, identity, new_start, cancelled), the first of an identity counting.

    A matched override replaces its occurrence, which goes if it moved out of
    range uncancelled; an unmatched one is added, marked mismatch, if it is in range.
    """
    first = F.row_number().over(Window.partitionBy("series_id", "identity").orderBy("new_start"))
    own = overrides.withColumn("n", first).where("n = 1").select("series_id", F.col("identity").alias("start"), "new_start", "cancelled")
    both = occurrences.join(own, ["series_id", "start"], "full_outer")
    inside = F.to_date("new_start").between(start, end)
    changed = F.col("new_start").isNotNull()
    kept = both.where(~changed | inside | (F.col("cancelled") & F.col("source").isNotNull()))
    status = F.when(changed & F.col("cancelled"), "Cancelled").when(changed, "Modified occurrence").when(F.col("source") == "rdate", "RDATE").otherwise("Recurring")
    return kept.select("series_id", F.col("start").alias("identity"), F.coalesce("new_start", "start").alias("start"), F.coalesce("source", F.lit("override")).alias("source"), status.alias("status"), (changed & F.col("source").isNull()).alias("mismatch"))


def this_and_future(occurrences: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Occurrences before their series' cutoff, (series_id, cutoff); series without one whole."""
    return occurrences.join(cutoffs, "series_id", "left").where("cutoff is null or start < cutoff").drop("cutoff")


def capped(occurrences: DataFrame, per_series: int = LIMITS.series_occurrences, total: int = LIMITS.occurrences) -> DataFrame:
    """Each series' first occurrences, then so many series' in order as fit the total; `truncated` tells of those cut.

    The running total is over one row per series, in ranges of series.
    """
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("start", "identity"))
    ranked = occurrences.withColumn("n", rank).where(F.col("n") <= per_series + 1)
    counts = ranked.groupBy("series_id").agg(F.count("*").alias("have"))
    sums = running_total(counts.withColumn("most", F.least("have", F.lit(per_series))), "series_id", "most", "before")
    room = sums.select("series_id", F.greatest(F.lit(0), F.least(F.lit(per_series), F.lit(total) - F.col("before"))).alias("room"), "have")
    return ranked.join(room, "series_id").where("n <= room").withColumn("truncated", F.col("have") > F.col("room")).drop("n", "room", "have")


def occurrence_end(start: Column, dtstart: Column, dtend: Column, duration: Column) -> Column:
    """start plus the master's length on the wall clock; null without an end or duration."""
    length = F.greatest(F.lit(0), F.coalesce(F.unix_seconds(dtend.cast("timestamp")) - F.unix_seconds(dtstart.cast("timestamp")), duration))
    return (start.cast("timestamp") + F.make_dt_interval(secs=length)).cast("timestamp_ntz")


WEEKDAYS = {"MO": "Monday", "TU": "Tuesday", "WE": "Wednesday", "TH": "Thursday", "FR": "Friday", "SA": "Saturday", "SU": "Sunday"}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
TOLD = ["FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "BYMONTHDAY", "WKST"]


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; last, 2nd last."""
    k = F.abs(n)
    ending = F.when((k % 100).between(11, 13), "th").when(k % 10 == 1, "st").when(k % 10 == 2, "nd").when(k % 10 == 3, "rd").otherwise("th")
    text = F.concat(k.cast("string"), ending)
    return F.when(n == -1, "last").when(n < 0, F.concat(text, F.lit(" last"))).otherwise(text)


def listed(words: Column, last: str) -> Column:
    """a; a and b; a, b and c."""
    n = F.size(words)
    return F.when(n <= 1, F.array_join(words, "")).otherwise(F.concat(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(last), F.element_at(words, -1)))


def rule_text(rrule: Column) -> Column:
    """A rule in English, or `Complex recurrence rule`; without a rule, `Additional dates without an RRULE`."""
    m = rule_map(rrule)
    n = F.coalesce(m["INTERVAL"].try_cast("int"), F.lit(1))
    unit = F.lower(F.when(m["FREQ"] == "DAILY", "DAY").otherwise(F.regexp_replace(m["FREQ"], "LY$", "")))
    every = F.when(n == 1, F.concat(F.lit("Every "), unit)).otherwise(F.concat(F.lit("Every "), n.cast("string"), F.lit(" "), unit, F.lit("s")))
    names = F.create_map(*(F.lit(x) for kv in WEEKDAYS.items() for x in kv))
    nth = lambda d: F.regexp_extract(d, r"^([+-]?\d+)", 1).try_cast("int")
    day = lambda d: F.concat(F.when(nth(d).isNotNull(), F.concat(F.lit("the "), ordinal(nth(d)), F.lit(" "))).otherwise(""), names[F.right(d, F.lit(2))])
    days = F.concat(F.lit(" on "), F.array_join(F.transform(F.split(m["BYDAY"], ","), day), ", "))
    dates = F.concat(F.lit(" on the "), listed(F.transform(F.split(m["BYMONTHDAY"], ","), lambda d: ordinal(d.try_cast("int"))), " and "))
    until = until_of(m)
    month = F.get(F.array(*map(F.lit, MONTHS)), F.month(until) - 1)
    ends = F.coalesce(F.concat(F.lit(" for "), m["COUNT"], F.when(m["COUNT"] == "1", " time").otherwise(" times")), F.concat(F.lit(" until "), month, F.lit(" "), F.day(until).cast("string"), F.lit(", "), F.year(until).cast("string")), F.lit(""))
    simple = rule_code(rrule).isNull() & (F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, TOLD)))) == 0) & m["FREQ"].isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY") & (m["BYDAY"].isNull() | m["BYMONTHDAY"].isNull())
    text = F.concat(every, F.coalesce(days, F.lit("")), F.coalesce(dates, F.lit("")), ends)
    return F.when(F.coalesce(rrule, F.lit("")) == "", "Additional dates without an RRULE").when(simple, text).otherwise("Complex recurrence rule")
