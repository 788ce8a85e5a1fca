"""Merging groups of contacts, and the decisions on them.

Groups are rows (group, idx). A plan lists each field's distinct values with
their first source; applying it takes the chosen contact's value, the primary
contact's, or the first there is, and unites the repeated fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import as_is, nfkc_each, normalize_email, normalize_name, normalize_phone, normalize_text
from ..sources.properties import vendor_properties
from .contact_duplicates import richness

#: Fields with one value: fixed by the tool.
FIELDS = ["formatted_name", "given_name", "family_name", "organization", "title", "role", "birthday", "anniversary", "nickname", "gender", "uid", "kind", "geo", "timezone"]
DECISIONS = ["merge", "keep", "not-duplicates"]


def primaries(contacts: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, idx): the richest member, then the one of the first source and place."""
    rows = groups.join(contacts.withColumn("rich", richness()), "idx")
    best = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("rich"), "source_index", "original_index"))
    return rows.withColumn("n", best).where("n = 1").select("group", "idx")


def plan(contacts: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, field, choices, conflict): distinct non-blank values with the first contact that has each."""
    stack = ", ".join(f"'{f}', coalesce({f}, '')" for f in FIELDS)
    long = groups.join(contacts, "idx").select("group", "idx", F.expr(f"stack({len(FIELDS)}, {stack}) as (field, value)")).where(F.trim("value") != "")
    key = F.when(F.col("field").contains("name"), normalize_name(F.col("value"))).otherwise(normalize_text(F.col("value")))
    first = long.withColumn("key", key).groupBy("group", "field", "key").agg(F.min(F.struct("idx", "value")).alias("first"))
    choices = F.transform(F.array_sort(F.collect_list("first")), lambda x: F.struct(x["value"].alias("value"), x["idx"].alias("idx")))
    return first.groupBy("group", "field").agg(choices.alias("choices")).withColumn("conflict", F.size("choices") > 1)


def plan_counters(contacts: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, contacts, conflicts, repeated_values, vendor_properties, media): what merging a group would bring together."""
    repeated = F.size("emails") + F.size("phones") + F.size("addresses") + F.size("urls") + F.size("categories")
    media = F.col("photo").isNotNull().cast("int") + F.col("logo").isNotNull().cast("int")
    rows = groups.join(contacts, "idx")
    vendor = F.flatten(F.collect_list("raw_properties"))  # a group has at most Limits.group_members contacts
    sums = rows.groupBy("group").agg(F.count("*").alias("contacts"), F.sum(repeated).alias("repeated_values"), F.size(vendor_properties(vendor)).cast("long").alias("vendor_properties"), F.sum(media).alias("media"))
    conflicts = plan(contacts, groups).groupBy("group").agg(F.count_if("conflict").alias("conflicts"))
    return sums.join(conflicts, "group", "left").select("group", "contacts", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), "repeated_values", "vendor_properties", "media")


def apply(contacts: DataFrame, groups: DataFrame, selections: DataFrame | None = None, notes: str = "primary") -> DataFrame:
    """One merged contact per group. selections: (group, field, idx); notes: primary or combine."""
    rows = groups.join(contacts, "idx")
    top = primaries(contacts, groups).withColumnRenamed("idx", "primary")
    rows = rows.join(top, "group")
    if selections is not None:
        wanted = selections.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("field", "idx"))).alias("chosen"))
        rows = rows.join(wanted, "group", "left")
    else:
        rows = rows.withColumn("chosen", F.lit(None).cast("map<string,bigint>"))
    place = F.struct("source_index", "original_index")

    def single(f: str) -> Column:
        # the chosen contact first, then the primary one, then by place; blank values last
        blank = (F.trim(F.coalesce(f, F.lit(""))) == "").cast("int")
        rank = F.when(F.col("chosen")[f] == F.col("idx"), 0).when(F.col("idx") == F.col("primary"), 1).otherwise(2)
        return F.min_by(f, F.struct(blank, rank, place)).alias(f)

    def listed(c: str) -> Column:
        # values may hold maps, which have no order of their own
        by_place = lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)
        return F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col(c).alias("v"))), by_place), lambda x: x["v"])

    longest = lambda c: F.max_by(c, F.struct(F.size(c), -F.col("source_index"), -F.col("original_index")))
    own = F.filter(F.transform(listed("notes"), lambda n: n), lambda n: F.size(n) > 0)
    every = F.array_distinct(F.flatten(own))
    primary_notes = F.max_by("notes", (F.col("idx") == F.col("primary")).cast("int"))
    merged = rows.groupBy("group").agg(
        F.concat(F.lit("merged:"), F.array_join(F.array_sort(F.collect_list("id")), ",")).alias("id"), F.lit("4.0").alias("version"), *(single(f) for f in FIELDS),
        *(longest(c).alias(c) for c in ("additional_names", "honorific_prefixes", "honorific_suffixes", "organization_units")),
        *(F.flatten(listed(c)).alias(c) for c in ("emails", "phones", "addresses", "urls")), vendor_properties(F.flatten(listed("raw_properties"))).alias("raw_properties"), F.array_distinct(F.flatten(listed("categories"))).alias("categories"),
        F.when((F.size(every) <= 1) | F.lit(notes == "combine"), every).otherwise(primary_notes).alias("notes"), F.bool_or(F.col("photo").isNotNull() | F.col("logo").isNotNull()).alias("media_removed"), F.first("primary").alias("primary"),
    )
    united = merged
    for c, key in (("emails", normalize_email), ("phones", normalize_phone), ("addresses", normalize_text), ("urls", lambda v, form: form(F.trim(v)))):
        united = united.withColumn("_raw", nfkc_each(F.col(c)["value"])).withColumn(c, unite(F.col(c), F.col("_raw"), key))
    return united.drop("_raw")


def unite(values: Column, raw: Column, key) -> Column:
    """The first struct of each non-empty key with the types and parameters of all; a preference stays if there is no other. raw: the values in NFKC."""
    keyed = F.filter(F.transform(values, lambda x, i: F.struct(key(F.get(raw, i), as_is).alias("k"), x.alias("v"))), lambda x: x["k"] != "")

    def one(same: Column) -> Column:
        prefs = F.array_distinct(F.filter(F.transform(same, lambda x: x["v"]["preference"]), lambda p: p.isNotNull()))
        types = F.array_distinct(F.flatten(F.transform(same, lambda x: x["v"]["types"])))
        named = F.flatten(F.transform(same, lambda x: F.map_entries(F.coalesce(x["v"]["parameters"], F.expr("cast(map() as map<string,array<string>>)")))))
        return F.get(same, F.lit(0))["v"].withField("types", types).withField("parameters", let(named, joined)).withField("preference", let(prefs, lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0)))))

    def joined(named: Column) -> Column:
        names = F.array_distinct(F.transform(named, lambda e: e["key"]))
        return let(names, lambda names: F.map_from_arrays(names, F.transform(names, lambda n: F.array_distinct(F.flatten(F.transform(F.filter(named, lambda e: e["key"] == n), lambda e: e["value"]))))))

    # bound, as Spark would work out all keys again at each mention, for each key
    return let(keyed, lambda kept: F.transform(F.array_distinct(F.transform(kept, lambda x: x["k"])), lambda k: let(F.filter(kept, lambda x: x["k"] == k), one)))


# decisions on groups


def latest(resolutions: DataFrame) -> DataFrame:
    """Each group's last decision of (seq, group, type); `undo` takes back the one before it, `reset` all."""
    reset = F.coalesce(F.max(F.when(F.col("type") == "reset", F.col("seq"))).over(Window.partitionBy("group")), F.lit(-1))
    live = resolutions.withColumn("reset", reset).where("seq > reset").where("type <> 'reset'")
    # walking back, an undo cancels the nearest decision that no later undo has cancelled
    depth = F.sum(F.when(F.col("type") == "undo", 1).otherwise(-1)).over(Window.partitionBy("group").orderBy(F.desc("seq")))
    least = F.least(F.lit(0), F.coalesce(F.min("depth").over(Window.partitionBy("group").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = live.withColumn("depth", depth).withColumn("least", least).where("type <> 'undo' and depth < least")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("seq")))).where("n = 1").select("group", "type", "seq")


def resolve_exact(groups: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Merge decisions for all undecided exact groups."""
    last = resolutions.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    open_ = groups.where("exact").join(latest(resolutions).select("group"), "group", "left_anti")
    return open_.crossJoin(last).select((F.col("last") + 1).alias("seq"), "group", F.lit("merge").alias("type"))  # `last` is one row


def derive(contacts: DataFrame, groups: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(idx, id, formatted_name, position, merged): what stays. A merged group stands at its first member's place."""
    merged_groups = groups.join(latest(resolutions).where("type = 'merge'").select("group"), "group", "left_semi")
    gone = contacts.select("idx", "id", "formatted_name").join(merged_groups.select("idx"), "idx", "left_anti")
    at = merged_groups.groupBy("group").agg(F.min("idx").alias("position"))
    made = apply(contacts, merged_groups).join(at, "group").select(F.col("primary").alias("idx"), "id", "formatted_name", "position", F.lit(True).alias("merged"))
    return gone.select("idx", "id", "formatted_name", F.col("idx").alias("position"), F.lit(False).alias("merged")).unionByName(made)
