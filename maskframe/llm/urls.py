"""URL filters by empirical-Bayes host reputation; DataFrame functions only.

Explicit rules come first (the longest that fits). Every other page is judged by its host: labelled
page outcomes are counted by host, registered domain and suffix, and each level's rate is shrunk
towards its parent's by a beta-binomial prior whose strength is estimated from how much the level's
rates vary (moments). A host is blocked when the lower bound of its posterior bad rate is above the
limit, so that few labels never block.

Counts are pre-aggregated before any shuffle; the driver sees four numbers a level. The reputation
table has a row a host; in the join with the pages the rows of frequent hosts are dealt out.

The built-in list of suffixes is short (``TWO_LABELS``): under any other suffix of two labels, and for
addresses, hosts count as one domain. Give ``suffixes``, a table of the public ones, for real hosts.

Defined results: a null url or one without ``://`` has empty host and path and is judged as the empty
host; labels with neither outcome set are ignored, several labels of one page count as one, bad if any
is; repeated rows get equal results; without labels every page is allowed; other columns are ignored.
"""

from __future__ import annotations

import string

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from maskframe.llm import common

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels; every other suffix is the last label.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn")
LIMIT, Z = 0.5, 1.645
_STRONGEST, _WEAKEST = 1e6, 1e-6


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(rules: tuple) -> list[tuple[str, str, str, str]]:
    split = [(verdict, rule, *rule.split("/", 1)) for verdict, rule in rules]
    return sorted(split, key=lambda r: (-len(r[1]), -len(r[2]), r[1]))


def rule_of(host: Column, path: Column, rules: tuple = RULES, what: int = 1) -> Column:
    """The longest rule that fits (``what`` 1) or its verdict (0); null if none does. Rules are a short
    list given by the caller; they become one expression."""
    chain = None
    for verdict, rule, name, start in _ordered(rules):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        value = F.lit((verdict, rule)[what])
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return F.lit(None).cast("string") if chain is None else chain


def levels(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host, without user and port."""
    labels = F.split(F.regexp_replace(host, "^.*@|:[0-9]*$", ""), "\\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = last(2).isin(*TWO_LABELS)
    return F.when(two, last(2)).otherwise(last(1)), F.when(two, last(3)).otherwise(last(2))


def _strength(rows: DataFrame) -> float:
    """The prior's strength at a level of (n, bad, parent): from how far its rates lie from their
    parents', over what the counts alone explain."""
    miss = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("parent"), 2) / (F.col("parent") * (1 - F.col("parent")))
    groups, total, squares, chi = rows.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(miss)).first()
    return strength(groups, total or 0, squares or 0, chi or 0.0)


def strength(groups: int, total: int, squares: int, chi: float) -> float:
    """Prior strength from the moments of a level; one group tells nothing, so it is pooled."""
    room = total - squares / total - (groups - 1) if total else 0.0
    if room <= 0:
        return _STRONGEST
    rho = min(max((chi - (groups - 1)) / room, 1 / (1 + _STRONGEST)), 1 / (1 + _WEAKEST))
    return (1 - rho) / rho


def with_levels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` with suffix and domain: the longest of ``suffixes`` (suffix) that ends the host and one label more;
    an address, and a host that no suffix ends, stands for itself. Without a table levels() decides."""
    host = F.col("host")
    if suffixes is None:
        suffix, domain = levels(host)
        return hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    labels = F.split(F.regexp_replace(host, "^.*@|:[0-9]*$", ""), "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("tail"), k.alias("k")))
    met = hosts.select("host", F.explode(tails).alias("t")).join(suffixes.select(F.col("suffix").alias("of")).distinct(), F.col("t.tail") == F.col("of"))
    best = met.groupBy(host.alias("named")).agg(F.min(F.struct("t.k", "of")).alias("best"))
    joined = hosts.join(best, host == F.col("named"), "left").withColumn("suffix", F.coalesce("best.of", "host"))
    whole = F.array_join(F.slice(labels, F.greatest(F.col("best.k") - 1, F.lit(1)), F.size(labels)), ".")
    return joined.withColumn("domain", F.when(F.col("best").isNull(), host).otherwise(whole)).drop("named", "best")


def reputation(hosts: DataFrame, counts: DataFrame, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, mean, low, high): posterior of the bad rate of every host in ``hosts`` (host),
    from ``counts`` (host, n, bad)."""
    seen = common.materialize(with_levels(counts, suffixes).select("host", "suffix", "domain", "n", "bad"), "hosts")
    total, bad = seen.agg(F.sum("n"), F.sum("bad")).first()
    whole = ((bad or 0) + 0.5) / ((total or 0) + 1)

    def shrunk(level: DataFrame, key: str, *of: str) -> tuple[DataFrame, float]:
        k = _strength(level)
        return level.select(*of, key, ((F.col("bad") + k * F.col("parent")) / (F.col("n") + k)).alias(f"{key}_mean")), k

    def summed(*keys: str) -> DataFrame:
        return seen.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    by_suffix, _ = shrunk(summed("suffix").withColumn("parent", F.lit(whole)), "suffix")
    domains, _ = shrunk(summed("suffix", "domain").join(by_suffix, "suffix").withColumnRenamed("suffix_mean", "parent"), "domain", "suffix")
    k = _strength(seen.join(domains, ["suffix", "domain"]).withColumnRenamed("domain_mean", "parent"))
    named = with_levels(hosts, suffixes).select("host", "suffix", "domain").join(seen.select("host", "n", "bad"), "host", "left")
    known = named.join(domains, ["suffix", "domain"], "left").join(by_suffix, "suffix", "left")
    parent = F.coalesce("domain_mean", "suffix_mean", F.lit(whole))
    n, b = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    mean = (b + k * parent) / (n + k)
    spread = z * F.sqrt(mean * (1 - mean) / (n + k + 1))
    return known.select("host", n.alias("n"), b.alias("bad"), mean.alias("mean"), (mean - spread).alias("low"), (mean + spread).alias("high"))


def outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad): labelled outcomes; a page is bad if it is toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad")).where("bad IS NOT NULL")


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES, limit: float = LIMIT, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_mean, bad_low) of each page."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marked = labelled.select(F.col("page_id").alias("of"), F.col("bad").alias("is_bad"))
    counts = rows.join(marked, F.col("page_id") == F.col("of")).groupBy("host").agg(F.count("*").alias("n"), F.sum("is_bad").alias("bad"))
    hosts = common.materialize(rows.groupBy("host").agg(F.count("*").alias("n")), "pages-of-hosts")
    known = common.materialize(reputation(hosts.select("host"), counts, z, suffixes).select("host", "mean", "low"), "reputation")
    found = common.join_split(rows, known, "host", hosts, F.concat_ws("|", F.col("page_id").cast("string"), "path"))
    ruled = rule_of(F.col("host"), F.col("path"), rules, 0)
    return found.select(
        "page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"),
        F.coalesce(ruled, F.when(F.col("low") > limit, "block").otherwise("allow")).alias("verdict"), F.col("mean").alias("bad_mean"), F.col("low").alias("bad_low"),
    )


def verdicts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return judge(pages, outcomes(labels)).select("page_id", "host", "path", "rule", "verdict")


def sql(rules: tuple = RULES, limit: float = LIMIT, z: float = Z) -> str:
    """DuckDB SQL for verdicts()."""

    def cased(what: int) -> str:
        whens = " ".join(
            f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{(verdict, rule)[what]}'" for verdict, rule, name, start in _ordered(rules)
        )
        return f"CASE {whens} END"

    def level(name: str, source: str, parent: str) -> str:
        return f"""{name}_m AS (SELECT count(*)::DOUBLE g, sum(n)::DOUBLE t, sum(n * n)::DOUBLE s, sum(n * pow(bad / n - {parent}, 2) / ({parent} * (1 - {parent}))) chi FROM {source}),
{name}_r AS (SELECT CASE WHEN t - s / t - (g - 1) > 0 THEN least(greatest((chi - (g - 1)) / (t - s / t - (g - 1)), 1 / (1 + {_STRONGEST})), 1 / (1 + {_WEAKEST})) ELSE 1 / (1 + {_STRONGEST}) END rho FROM {name}_m),
{name}_k AS (SELECT (1 - rho) / rho k FROM {name}_r)"""

    two = ", ".join(f"'{x}'" for x in TWO_LABELS)
    return f"""
WITH rows AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path FROM pages),
marks AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) bad FROM labels GROUP BY doc_id),
named AS (
  SELECT host, CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END suffix,
    CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
  FROM (SELECT host, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') l FROM (SELECT DISTINCT host FROM rows))),
seen AS (
  SELECT host, suffix, domain, count(*) n, sum(bad)::BIGINT bad FROM rows JOIN marks ON page_id = doc_id JOIN named USING (host) WHERE bad IS NOT NULL GROUP BY ALL),
whole AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) m FROM seen),
s AS (SELECT suffix, sum(n) n, sum(bad) bad, (SELECT m FROM whole) parent FROM seen GROUP BY suffix),
{level("s", "s", "parent")},
sm AS (SELECT suffix, (bad + k * parent) / (n + k) sm FROM s, s_k),
d AS (SELECT suffix, domain, sum(n) n, sum(bad) bad, any_value(sm) parent FROM seen JOIN sm USING (suffix) GROUP BY suffix, domain),
{level("d", "d", "parent")},
dm AS (SELECT domain, (bad + k * parent) / (n + k) dm FROM d, d_k),
h AS (SELECT host, n, bad, dm parent FROM seen JOIN dm USING (domain)),
{level("h", "h", "parent")},
judged AS (
  SELECT host, n, k, (coalesce(bad, 0) + k * coalesce(dm, sm, (SELECT m FROM whole))) / (coalesce(n, 0) + k) mu
  FROM named LEFT JOIN (SELECT host, n, bad FROM seen) USING (host) LEFT JOIN dm USING (domain) LEFT JOIN sm USING (suffix), h_k)
SELECT page_id, host, path, {cased(1)} AS rule,
  coalesce({cased(0)}, CASE WHEN mu - {z} * sqrt(mu * (1 - mu) / (coalesce(n, 0) + k + 1)) > {limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM rows JOIN judged USING (host)"""
