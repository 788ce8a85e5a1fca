import datetime as dt
import random
import signal
import time
from collections import Counter

from dateutil.rrule import rrulestr

from kalends.operators.recurrence import expand_rules

START, END = "2023-11-01", "2025-02-28"


def expanded(spark, rules, start=START, end=END):
    rows = [(str(i), first, rule) for i, (rule, first) in enumerate(rules)]
    df = spark.createDataFrame(rows, "series_id string, dtstart timestamp_ntz, rrule string")
    out = {}
    for r in expand_rules(df, start, end, 10**9).collect():
        out.setdefault(int(r.series_id), []).append(r.start)
    return {i: sorted(x) for i, x in out.items()}


def wanted(rule, first, start=START, end=END):
    lo, hi = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end) + dt.timedelta(hours=23, minutes=59, seconds=59)
    bounded = rule if "UNTIL" in rule else f"{rule};UNTIL={hi:%Y%m%dT%H%M%S}"  # it would look for more until the year 9999
    return [x for x in rrulestr(bounded, dtstart=first) if lo <= x <= hi]


class TooLong(Exception):
    pass


def soon(rule, first):
    """What dateutil finds within half a second; it walks to the year 9999 for rules that find nothing."""

    def stop(*_):
        raise TooLong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, 0.5)
    try:
        return wanted(rule, first)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def some(rng, low, high, most=3):
    return ",".join(map(str, sorted(rng.sample([n for n in range(low, high + 1) if n or low >= 0], rng.randint(1, most)))))


def random_rule(rng):
    freq = rng.choice(["YEARLY", "YEARLY", "MONTHLY", "MONTHLY", "WEEKLY", "WEEKLY", "DAILY", "HOURLY", "MINUTELY"])
    parts = [f"FREQ={freq}"]
    if rng.random() < 0.4:
        parts.append(f"INTERVAL={rng.choice([2, 3, 5, 7]) if freq != 'MINUTELY' else rng.choice([45, 90, 1440])}")
    elif freq == "MINUTELY":
        parts.append("INTERVAL=30")
    if rng.random() < 0.35:
        parts.append(f"BYMONTH={some(rng, 1, 12)}")
    names = rng.sample(["MO", "TU", "WE", "TH", "FR", "SA", "SU"], rng.randint(1, 3))
    if rng.random() < 0.45:
        nth = freq in ("YEARLY", "MONTHLY") and rng.random() < 0.6
        parts.append("BYDAY=" + ",".join((str(rng.choice([1, 2, 4, 5, -1, -2, 11])) if nth else "") + d for d in names))
    if rng.random() < 0.3:
        parts.append(f"BYMONTHDAY={some(rng, -31, 31)}")
    if rng.random() < 0.12:
        parts.append(f"BYYEARDAY={some(rng, -366, 366)}")
    if freq == "YEARLY" and rng.random() < 0.25:
        parts.append(f"BYWEEKNO={some(rng, -20, 53)}")
    if rng.random() < 0.3:
        parts.append(f"BYHOUR={some(rng, 0, 23)}")
    if rng.random() < 0.2:
        parts.append(f"BYMINUTE={some(rng, 0, 59)}")
    if rng.random() < 0.1 and freq != "MINUTELY":
        parts.append(f"BYSECOND={some(rng, 0, 59)}")
    if len(parts) > 2 and rng.random() < 0.3:
        parts.append(f"BYSETPOS={some(rng, -4, 4)}")
    if rng.random() < 0.3:
        parts.append(f"WKST={rng.choice(names)}")
    if rng.random() < 0.3:
        parts.append(f"COUNT={rng.choice([1, 5, 40, 300])}")
    elif rng.random() < 0.3:
        parts.append(f"UNTIL=2024{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}T120000")
    return ";".join(parts)


def test_random_rules_equal_dateutil(spark):
    rng = random.Random(9)
    rules, want = [], {}
    while len(rules) < 400:
        rule = random_rule(rng)
        first = dt.datetime(rng.choice([2021, 2023, 2024]), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.choice([0, 0, 30])) + dt.timedelta(days=rng.randint(0, 3))
        try:
            found = soon(rule, first)
        except ValueError:  # an interval that never meets the other parts
            found = []
        except (IndexError, TooLong):  # the eleventh Monday of a month
            continue
        if len(found) < 3000:
            if found:
                want[len(rules)] = found
            rules.append((rule, first))
    got = expanded(spark, rules)
    assert len(want) > 200
    for i, (rule, first) in enumerate(rules):
        assert got.get(i, []) == want.get(i, []), (rule, first)


OLD = ["FREQ=MINUTELY", "FREQ=DAILY;BYMONTH=2;BYMONTHDAY=30", "FREQ=MINUTELY;BYHOUR=9;BYMINUTE=0,30", "FREQ=SECONDLY;INTERVAL=3600;BYDAY=MO", "FREQ=HOURLY;INTERVAL=7;BYSETPOS=-1;BYMINUTE=0,30", "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1"]


def test_old_series_take_no_longer_than_new_ones(spark):
    first, days = dt.datetime(1900, 1, 1, 8), ("2024-02-26", "2024-03-03")
    expanded(spark, [(rule, first.replace(year=2024)) for rule in OLD], *days)
    began = time.perf_counter()
    expanded(spark, [(rule, first.replace(year=2024)) for rule in OLD], *days)
    new = time.perf_counter() - began
    got = expanded(spark, [(rule, first) for rule in OLD], *days)
    assert time.perf_counter() - began < 4 * new + 10  # walking from the start takes minutes
    for i, rule in enumerate(OLD):
        if "MINUTELY" in rule:
            near = wanted(rule, dt.datetime(2024, 1, 1, 8), *days)
        elif "SECONDLY" in rule:
            near = [dt.datetime(2024, 2, 26, h) for h in range(24)]
        else:
            near = [] if "30" in rule and "DAILY" in rule else wanted(rule, first, *days)
        assert got.get(i, []) == near, rule


def test_counts_begin_with_the_series(spark):
    first = dt.datetime(2014, 1, 1, 8)
    rules = ["FREQ=MINUTELY;INTERVAL=1440;COUNT=3750", "FREQ=MONTHLY;BYMONTHDAY=31;COUNT=75", "FREQ=DAILY;BYDAY=MO,WE;COUNT=1100", "FREQ=SECONDLY;BYHOUR=9;BYMINUTE=0;BYSECOND=0,30;BYMONTHDAY=1;COUNT=250", "FREQ=YEARLY;COUNT=11"]
    got = expanded(spark, [(r, first) for r in rules])
    for i, rule in enumerate(rules):
        want = wanted(rule, first) if "SECONDLY" not in rule else wanted("FREQ=MONTHLY;BYMONTHDAY=1;BYHOUR=9;BYMINUTE=0;BYSECOND=0,30;COUNT=250", first)
        assert got.get(i, []) == want, rule


def series_of(spark, rows):
    return spark.createDataFrame(rows, "series_id string, dtstart timestamp_ntz, rrule string")


def test_rules_are_dealt_and_not_their_occurrences(spark):
    """Occurrences were shuffled to be ranked, and sets of a period were expanded beside other rules."""
    rows = [("a", "FREQ=MONTHLY;BYDAY=MO;COUNT=3"), ("b", "FREQ=MONTHLY;BYMONTHDAY=1,15"), ("c", "FREQ=YEARLY;BYMONTH=2,3;BYDAY=TU,FR;BYSETPOS=1,-1")]
    df = expand_rules(series_of(spark, [(k, dt.datetime(2026, 1, 1, 9), r) for k, r in rows]), "2026-01-01", "2026-06-30")
    text = df._jdf.queryExecution().executedPlan().toString()
    ranked = text.index("row_number()")
    assert text.index("Generate", ranked) < text.index("Exchange", ranked)
    assert Counter(r.series_id for r in df.collect()) == {"a": 3, "b": 12, "c": 2}


def test_series_that_begin_after_the_range_are_left_out_first(spark):
    """Their rules were taken apart, too; one that begins on the last day, or has no start, isn't left out."""
    rows = [("a", dt.datetime(2026, 1, 31, 23, 59, 59, 500_000), "FREQ=DAILY"), ("b", dt.datetime(2026, 2, 1), "FREQ=DAILY"), ("c", None, "FREQ=DAILY;COUNT=2"), ("d", None, "FREQ=MONTHLY"), ("e", dt.datetime(2026, 1, 31), "FREQ=MONTHLY;BYMONTHDAY=31")]
    df = expand_rules(series_of(spark, rows), "2026-01-01", "2026-01-31")
    assert "dtstart" in df._jdf.queryExecution().optimizedPlan().toString().split("Filter")[-1][:60]
    assert sorted((r.series_id, str(r.start)) for r in df.collect()) == [("a", "2026-01-31 23:59:59"), ("c", "None"), ("c", "None"), ("e", "2026-01-31 00:00:00")]


def test_rows_of_one_series_are_ranked_together(spark):
    """Ids that repeat, null ones too: a row's COUNT counts the occurrences of all rows, with COUNT or without."""
    rules = ["FREQ=MONTHLY;BYMONTHDAY=5;COUNT=4", "FREQ=MONTHLY;BYDAY=1MO;COUNT=6", "FREQ=MONTHLY;BYDAY=MO,TU;BYSETPOS=-1"]
    rows = [(k, dt.datetime(2026, 1, 1, 9, i), r) for k in ("a", None) for i, r in enumerate(rules)]
    got = [(r.series_id, r.start) for r in expand_rules(series_of(spark, [*rows, ("b", *rows[0][1:])]), "2026-01-01", "2026-12-31").collect()]
    every = sorted((t, 0 if i == 0 else 6 if i == 1 else 99, i) for i in range(3) for t in rrulestr(rules[i].replace(";COUNT=4", ";COUNT=400").replace(";COUNT=6", ";COUNT=400"), dtstart=dt.datetime(2026, 1, 1, 9, i)).between(dt.datetime(2026, 1, 1), dt.datetime(2026, 12, 31)))
    want = [t for n, (t, _, i) in enumerate(every, 1) if n <= (4, 6, 99)[i]]
    for k in ("a", None):
        assert sorted(t for x, t in got if x == k) == want
    assert sum(x == "b" for x, _ in got) == 4
