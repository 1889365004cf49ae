"""Redaction targets of network logs: one row a (section, name, value), counted over all entries.

values: (har_id, entry, section, name, value, method, url). Frequent headers stand in every entry, so
rows are aggregated before the shuffle and locations are picked by a window over salted groups first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.functions import network
from maskframe.functions.fakes import fake, scramble
from maskframe.functions.hashing import SEED
from maskframe.functions.paths import truncated

LOCATIONS, SHOWN, SALTS = 20, 512, 32
GROUPS, VALUES = 250, 100
CATEGORIES = {"header": "headers", "cookie": "headers", "param": "params", "body": "bodies", "ip": "ips"}


def replacement(section: Column, name: Column, value: Column, seed: Column | str = SEED) -> Column:
    """What a redacted value becomes."""
    return (
        F.when((section == "header") & F.lower(name).isin(*network.LINK_HEADERS), network.redact_url(value, seed))
        .when((section == "header") & F.lower(name).isin("authorization", "proxy-authorization"), network.fake_auth(value, seed))
        .when(section == "ip", fake("ipv4", value, seed))
        .otherwise(scramble(value, seed, every=True))
    )


def judged(values: DataFrame) -> DataFrame:
    """``values`` with target_key and redact; empty values are no targets."""
    section, name, value = F.col("section"), F.col("name"), F.col("value")
    full = values.where("value IS NOT NULL AND value <> ''")
    return full.select("*", network.target_key(section, name, value).alias("target_key"), network.default_redact(section, name, value).alias("redact"))


def targets(values: DataFrame, seed: Column | str = SEED) -> DataFrame:
    """(target_key, section, name, original, replacement, redact, occurrences, first_entry) of each target."""
    found = judged(values).groupBy("target_key").agg(
        F.count("*").alias("occurrences"), F.min_by(F.struct("section", "name", "value", "redact"), F.struct("har_id", "entry", "name")).alias("first"), F.min("entry").alias("first_entry")
    )
    section, name, value = F.col("first.section"), F.col("first.name"), F.col("first.value")
    made = F.when(F.col("first.redact"), replacement(section, name, value, seed)).otherwise(value)
    return found.select(
        "target_key", section.alias("section"), name.alias("name"), truncated(value, SHOWN).alias("original"), truncated(made, SHOWN).alias("replacement"),
        F.col("first.redact").alias("redact"), "occurrences", "first_entry",
    )


def locations(values: DataFrame, count: int = LOCATIONS) -> DataFrame:
    """(target_key, har_id, entry) of the first ``count`` distinct entries of each target. A hot target's
    rows are spread over salts, cut there, and only what is left meets."""
    rows = judged(values).select("target_key", "har_id", "entry").distinct().withColumn("salt", F.pmod(F.xxhash64("har_id", "entry"), F.lit(SALTS)))
    first = Window.partitionBy("target_key", "salt").orderBy("har_id", "entry")
    last = Window.partitionBy("target_key").orderBy("har_id", "entry")
    cut = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= count)
    return cut.withColumn("n", F.row_number().over(last)).where(F.col("n") <= count).drop("salt")


def stats(values: DataFrame) -> DataFrame:
    """Entries and redactions by section of each log."""
    rows = judged(values)
    counts = [F.count_if(F.col("redact") & (F.col("section") == s)).alias(f"{s}s_redacted") for s in ("header", "cookie", "param", "ip")]
    return rows.groupBy("har_id").agg(F.count_distinct("entry").alias("entries"), *counts)


def category_counts(found: DataFrame) -> DataFrame:
    """Targets and intended redactions by policy category, from targets()."""
    category = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))[F.col("section")]
    return found.groupBy(category.alias("category")).agg(F.count("*").alias("targets"), F.count_if("redact").alias("redacted"), F.sum("occurrences").alias("occurrences"))


def top_groups(found: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(section, name, n, flagged, place): groups with something flagged first, then by name."""
    grouped = found.groupBy("section", F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.count_if("redact").alias("flagged"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc(F.col("flagged") > 0), "name"))
    return grouped.withColumn("place", place).where(F.col("place") <= groups)


def value_tree(found: DataFrame, search: str = "", untouched: bool = False, overridden: DataFrame | None = None, groups: int = GROUPS, values: int = VALUES) -> DataFrame:
    """(section, name, place, value_place, target_key, original, replacement, redact, occurrences): what a reviewer sees of targets().

    Shown are flagged targets (redacted by default, or in ``overridden``, a table of target_key); all of them if ``untouched``;
    or, if ``search`` is not empty, those with it in name, original or replacement in any case. Header names group in any
    case, others as written; a group has the name of its first target. Groups with something redacted come first, then by name, ``groups`` a section;
    a group's targets by first entry, then by original, ``values`` a group. Both cuts are made before rows are shuffled.
    At most ``groups`` a section are left, so the groups are broadcast."""
    rows = found.withColumn("__group", F.when(F.col("section") == "header", F.lower("name")).otherwise(F.col("name")))
    if search:
        hit = F.lit(False)
        for column in ("name", "original", "replacement"):
            hit = hit | F.contains(F.lower(column), F.lit(search.strip().lower()))
        rows = rows.where(hit)
    elif not untouched:
        flagged = F.col("redact")
        if overridden is not None:
            rows = rows.join(overridden.select("target_key").distinct().withColumn("__set", F.lit(True)), "target_key", "left")
            flagged = flagged | F.col("__set").isNotNull()
        rows = rows.where(flagged)
    order = F.struct("first_entry", "original", "target_key")
    grouped = rows.groupBy("section", "__group").agg(F.max("redact").alias("any"), F.min_by("name", order).alias("__label"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("any"), "__label", "__group"))
    shown = grouped.withColumn("place", place).where(F.col("place") <= groups).select(F.col("section").alias("__s"), F.col("__group").alias("__g"), "__label", "place")
    inside = F.row_number().over(Window.partitionBy("section", "__group").orderBy("first_entry", "original", "target_key"))
    kept = rows.withColumn("value_place", inside).where(F.col("value_place") <= values)
    met = kept.join(F.broadcast(shown), (F.col("section") == F.col("__s")) & (F.col("__group") == F.col("__g")))
    return met.select("section", F.col("__label").alias("name"), "place", "value_place", "target_key", "original", "replacement", "redact", "occurrences")


def redact_values(items: Column, section: str, seed: Column | str = SEED) -> Column:
    """An array of (name, value) with what is redacted by default replaced; order and names stay."""

    def item(x: Column) -> Column:
        redact = network.default_redact(F.lit(section), x["name"], x["value"])
        return F.struct(x["name"].alias("name"), F.when(redact, replacement(F.lit(section), x["name"], x["value"], seed)).otherwise(x["value"]).alias("value"))

    return F.transform(items, item)


def explode_values(entries: DataFrame) -> DataFrame:
    """values rows of entries (har_id, entry, method, url, headers, cookies, params, server_ip)."""
    parts = [
        entries.select("har_id", "entry", F.lit(section).alias("section"), F.explode(column).alias("x"), "method", "url").select("har_id", "entry", "section", "x.name", "x.value", "method", "url")
        for section, column in (("header", "headers"), ("cookie", "cookies"), ("param", "params"))
    ]
    ips = entries.select("har_id", "entry", F.lit("ip").alias("section"), F.lit("serverIPAddress").alias("name"), F.col("server_ip").alias("value"), "method", "url")
    out = parts[0]
    for part in (*parts[1:], ips):
        out = out.unionByName(part)
    return out


def size_gate(size: Column, silent: int = 75 << 20, ceiling: int = 250 << 20) -> Column:
    """ok, warn or refuse; nothing is ever cut short."""
    return F.when(size > ceiling, "refuse").when(size > silent, "warn").otherwise("ok")


def dedupe_files(files: DataFrame, *order: str) -> DataFrame:
    """The first file of each (name, size)."""
    return files.withColumn("n", F.row_number().over(Window.partitionBy("name", "size").orderBy(*order))).where("n = 1").drop("n")
