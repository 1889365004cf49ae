"""Secret scans over an incremental blob ledger; DataFrame functions only.

Every version of a document is addressed by the SHA-256 of its content. A ledger table holds one row a
(blob, rule version) that was ever scanned, with its findings, empty ones too. A run scans only pairs
the ledger lacks: one row stands for all copies of a blob, and it is found by an aggregation of ids
alone, so that a text moves once at most however many copies it has. Findings are joined back to all
paths. The rule version is a hash of the rules themselves, so edited rules scan anew. Give ``path`` for a
ledger that persists between runs; two runs that append the same blob at once leave it there twice, and
readers take it once.

Patterns run in time linear in the text: those of the kinds whose plain pattern would try every place of a
long run are anchored to the run's first character (``_ANCHORED``), which finds the same spans.

Defined results: a null text counts as empty; repeated rows and ids get equal results; a null id is
kept; an empty table gives an empty result; other columns are ignored; spans count code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from maskframe.llm import common


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind -> (pattern, group whose length counts, least length). The first three are the base kinds. A run
#: of one class that is too short has no part that is long enough, so least lengths of access and hex
#: are in the pattern; an assignment that is too short still uses up its text, so that one is not.
KINDS = {
    "assign": (rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "login": (r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@", 0, 10),
}
BASE = ("assign", "access", "hex")
#: What may stand between the lines of a key: blanks, or line ends written as escapes, as in JSON.
_GAP, _BASE64 = r"(?:\s|\\[nr])", r"(?:[A-Za-z0-9+/=]|\\/)"
#: What redact() looks for besides: a private key up to its END line, or its long lines where that is missing.
KEY_BODY = {
    "key": (
        rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:{_GAP}*+[A-Za-z-]++:(?:(?!\\[nr])[^\r\n])*+)*+(?:{_GAP}*+{_BASE64}++)*+{_GAP}*+-----END [A-Z ]*PRIVATE KEY-----|(?:{_GAP}++{_BASE64}{{40,}}+)*+)", 0, 1
    ),
}
#: Kinds in Java's dialect with the place where a match may begin made explicit: group 1 is what stands
#: before the span in its run of characters. Each run is looked at a fixed number of times.
_RUN = "[A-Za-z0-9_-]"
_ANCHORED = {
    "jwt": rf"(?<!{_RUN})((?:(?!eyJ{_RUN}){_RUN})*+)eyJ{_RUN}++\.eyJ{_RUN}++\.{_RUN}++",
    "login": r"(?<![a-z0-9+.-])([0-9+.-]*+)[a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/@]++@",
}
#: Patterns that find a text of some kind at once, where that is cheaper than the kind's own.
_HINTS = {"hex": "[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}", "login": "://[^\\x20\\x09-\\x0D/:@]+:"}
#: Matches whose places are summed in one go.
_PART = 256
_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with ``value`` evaluated once: a lambda's body is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _parts(rows: Column) -> Column:
    """An array in parts of ``_PART``: what grows within an expression is copied at every step, so it is kept short."""
    starts = F.sequence(F.lit(0), F.greatest((F.size(rows) - 1).cast("int"), F.lit(0)), F.lit(_PART))
    return F.transform(starts, lambda at: F.slice(rows, at + 1, _PART))


def version_of(kinds: dict = KINDS) -> str:
    """A name for the rules that changes whenever they do."""
    return hashlib.sha256(repr(sorted(kinds.items())).encode()).hexdigest()[:16]


def _found(text: Column, kind: str, kinds: dict) -> Column:
    """Spans of one kind, in order: matches and the gaps between them give the positions."""
    plain, group, least = kinds[kind]
    pattern = _ANCHORED.get(kind, plain)
    ahead = F.regexp_extract_all(text, F.lit(pattern), 1) if kind in _ANCHORED else None
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    sized = whole if not group else F.regexp_extract_all(text, F.lit(pattern), group)
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    before = ahead if ahead is not None else F.transform(whole, lambda _: F.lit(""))
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), sized.alias("sized"), before.alias("before"))
    number = list(kinds).index(kind)
    none = F.expr(f"CAST(array() AS {_SPANS})")

    def step(state: Column, row: Column) -> Column:
        begins = state["at"] + F.length(row["gap"])
        start, stop = begins + F.length(row["before"]), begins + F.length(row["whole"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), stop.alias("stop"))
        size = F.length(row["sized"]) - (0 if group else F.length(row["before"]))
        found = F.when(size >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    def placed(rows: Column) -> Column:
        return _bound(F.transform(_parts(rows), lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("found")), step)), shifted)

    def shifted(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("all"))
        begins = F.aggregate(parts, zero, lambda s, part: F.struct((s["at"] + part["at"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        moved = lambda s, by: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["stop"] + by).alias("stop"))
        return F.flatten(F.zip_with(parts, begins, lambda part, by: F.transform(part["found"], lambda s: moved(s, by))))

    spans = _bound(rows, placed)
    return F.when(text.rlike(_HINTS.get(kind, pattern)), spans).otherwise(none)


def spans_of(text: Column, kinds: dict = KINDS) -> Column:
    """All spans of a text, by start, then kind as listed."""
    return F.array_sort(F.concat(*(_found(text, kind, kinds) for kind in kinds)))


def shown(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, rule_version, spans) scanned so far; empty where nothing was written yet."""
    schema = StructType.fromDDL(f"blob binary, rule_version string, spans {_SPANS}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan(docs: DataFrame, path: str, rule_version: str | None = None, id_col: str = "doc_id", text_col: str = "text", kinds: dict = KINDS) -> int:
    """Scan the blobs of ``docs`` that the ledger at ``path`` lacks under ``rule_version`` (that of ``kinds``
    unless given) and append them; returns how many were scanned. A run that fails leaves the ledger as it
    was."""
    spark = docs.sparkSession
    rule_version = rule_version or version_of(kinds)
    texts = versions(docs, id_col, text_col, True)
    seen = ledger(spark, path).where(F.col("rule_version") == rule_version).select("blob")
    fresh = versions(docs, id_col, text_col).groupBy("blob").agg(F.min("id").alias("one")).join(seen, "blob", "left_anti")
    fresh = fresh.select(F.col("blob").alias("of"), "one")
    once = texts.join(fresh, (F.col("blob") == F.col("of")) & F.col("id").eqNullSafe(F.col("one")), "left_semi")
    found = once.select("blob", spans_of(F.col("text"), kinds).alias("spans"))
    rows = found.groupBy("blob").agg(F.max("spans").alias("spans")).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    rows = common.materialize(rows, "findings")
    rows.write.mode("append").parquet(path)
    return rows.count()


def earlier(docs: DataFrame, share: float = 0.9, id_col: str = "doc_id") -> DataFrame:
    """The rows up to about the ``share`` quantile of the ids: what an earlier run of a growing table had."""
    last = docs.agg(F.percentile_approx(id_col, share)).first()[0]
    return docs.where(F.col(id_col) <= last) if last is not None else docs.limit(0)


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, blob[, text]): the content address of every version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("blob"), *([text.alias("text")] if texts else []))


def _known(spark: SparkSession, path: str, rule_version: str) -> DataFrame:
    """(blob, spans) of the blobs with findings, each once."""
    rows = ledger(spark, path).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    return rows.groupBy("blob").agg(F.max("spans").alias("spans"))


def findings(docs: DataFrame, path: str, rule_version: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every version, from the ledger. Blobs without findings stay out of the join."""
    known = _known(docs.sparkSession, path, rule_version or version_of())
    joined = versions(docs, id_col, text_col).join(known, "blob", "left")
    return joined.select("id", F.coalesce("spans", F.expr(f"CAST(array() AS {_SPANS})")).alias("spans"))


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; scans what the ledger lacks first."""
    path = path or common.scratch_path(docs.sparkSession, "ledger")
    scan(docs, path)
    spans = F.col("spans")
    of_kind = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    base = F.sha2(shown(F.filter(spans, lambda s: s["kind"] < len(BASE))), 256)
    return findings(docs, path).select(F.col("id").alias("doc_id"), *counts, base.alias("base_sha256"), shown(spans).alias("spans"))


def _cleaned(text: Column, parts: Column, mark: str) -> Column:
    """``text`` with the spans of all parts replaced; each part works on its own piece of the text."""
    far = lambda part: F.array_max(F.transform(part, lambda s: s["stop"]))
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("all"))
    begins = F.aggregate(parts, zero, lambda s, part: F.struct(F.greatest(s["at"], far(part)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))

    def piece(part: Column, begin: Column) -> Column:
        def replaced(own: Column) -> Column:
            def step(state: Column, span: Column) -> Column:
                gap = F.substring(own, state["at"] - begin + 1, span["start"] - state["at"])
                out = F.when(span["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
                return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), out.alias("out"))

            return F.aggregate(part, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

        return _bound(F.substring(text, begin + 1, F.greatest(far(part) - begin, F.lit(0))), replaced)

    def joined(state: Column) -> Column:
        return F.concat(F.array_join(F.zip_with(parts, state["all"], piece), ""), F.substring(text, state["at"] + 1, F.length(text)))

    return _bound(begins, joined)


def redact(docs: DataFrame, mark: str = "[SECRET]", path: str | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; same columns. Overlapping spans are
    replaced as one, a private key with its whole body. Only texts with findings are touched."""
    path = path or common.scratch_path(docs.sparkSession, "ledger")
    kinds = KINDS | KEY_BODY
    scan(docs, path, kinds=kinds)
    known = _known(docs.sparkSession, path, version_of(kinds))
    known = known.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    text = F.col("text")

    clean = _bound(_parts(F.col("__spans")), lambda parts: _cleaned(text, parts, mark))
    blob = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    joined = docs.withColumn("__address", blob).join(known, F.col("__address") == F.col("__blob"), "left")
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), text).otherwise(clean)).select(*docs.columns)


def sql() -> str:
    """DuckDB SQL for report()."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def found(k: int, kind: str) -> str:
        pattern, group, least = KINDS[kind]
        p = quoted(pattern)
        ends = "list_sum(list_transform(g[1:i], lambda x: length(x)))"
        return f"""{kind} AS (SELECT doc_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'start': CAST({ends} + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS INT),
    'kind': {k}, 'stop': CAST({ends} + list_sum(list_transform(w[1:i], lambda x: length(x))) AS INT), 'size': length(p[i])}}), lambda s: s.size >= {least}) spans
  FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) w, regexp_extract_all(t, {p}, {group}) p, string_split_regex(t, {p}) g FROM texts))"""

    names = "[" + ", ".join(map(quoted, KINDS)) + "]"
    show = lambda s: f"array_to_string(list_transform({s}, lambda s: {names}[s.kind + 1] || ':' || s.start || ':' || s.stop), ',')"
    counts = ", ".join(f"len(list_filter(spans, lambda s: s.kind = {k}))::BIGINT n_{kind}" for k, kind in enumerate(BASE))
    whole = reduce(lambda a, b: f"list_concat({a}, {b})", [f"{kind}.spans" for kind in KINDS])
    joins = " ".join(f"JOIN {kind} USING (doc_id)" for kind in list(KINDS)[1:])
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') t FROM documents),
{", ".join(found(k, kind) for k, kind in enumerate(KINDS))},
every AS (SELECT doc_id, list_sort({whole}) spans FROM {next(iter(KINDS))} {joins})
SELECT doc_id, {counts}, sha256({show(f"list_filter(spans, lambda s: s.kind < {len(BASE)})")}) base_sha256, {show("spans")} spans FROM every"""
