"""Entries of network logs: redact names, values, URLs and bodies in place, list what was found, validate.

An entry is a row (har_id, entry, text). Its leaves are flattened with the section that each belongs to, each distinct
one of a batch is decided and faked once as Columns over rows (see ``coded``), and all are written back; unknown keys and order stay. Bodies are masked by the raw lane's rules
inside their own format, guard prefixes and chunks included; a body that does not parse stays as it is and is
reported.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField

from maskframe.functions import detect, network
from maskframe.functions.hashing import SEED
from maskframe.functions.paths import truncated
from maskframe.operators import coded, har, raw
from maskframe.sources import texts

_FIELDS = ("path", "norm_path", "kind", "value", "section", "name")
_FOUND = (*_FIELDS, "by_path")
# ---- Fixed values: where a log keeps what ----
_SECTIONS = (
    (re.compile(r"(request|response)\.headers\[\d+\]"), "header"), (re.compile(r"(request|response)\.cookies\[\d+\]"), "cookie"),
    (re.compile(r"request\.(queryString|postData\.params)\[\d+\]"), "param"),
)
_LISTS = {"request": (("headers", "header"), ("cookies", "cookie"), ("queryString", "param")), "response": (("headers", "header"), ("cookies", "cookie"))}
_PART = {"request": "postData", "response": "content"}
_URL = {"request": "url", "response": "redirectURL"}
_URLS = ("request.url", "response.redirectURL")
_ADDRESS = "serverIPAddress"
_BODIES = ("request.postData.text", "response.content.text")
KEPT_TYPES = ("country", "countryCode", "currency", "stateOrProvince", "isoDate", "sku")
# ---- End of fixed values ----
POLICY = {"headers": True, "params": True, "bodies": True, "ips": True}
#: By section, of what is redacted and of what is kept by default.
REASONS = {
    "header": ("credential header", "standard header"), "cookie": ("session or token cookie", "preference cookie"), "param": ("secret parameter", "plain parameter"),
    "url": ("secrets in the URL", "public URL"), "ip": ("public address", "private address"),
}
#: Types of bodies' values whose words are not those of their names.
KIND_WORDS = {
    "id": "identifier", "ipv4": "IP address", "uuid": "UUID", "isoDate": "date", "sku": "catalog data", "redact": "sensitive value", "country": "regional data", "countryCode": "regional data",
    "currency": "regional data", "stateOrProvince": "regional data",
}


def _maskable(mime: str, encoding: str) -> bool:
    kind = mime.split(";")[0].strip().lower()
    return encoding.lower() != "base64" and not re.match("(image|audio|video|font)/", kind) and bool(re.search("json|xml|x-www-form-urlencoded|csv", kind))


def _encoded(text: str) -> bool:
    return bool(re.match("\x1f|\x78[\x01\x5e\x9c\xda]", text) or re.search(r"[\x00-\x08\x0e-\x1f]", text[:64]) or (len(text) > 64 and re.fullmatch(r"[A-Za-z0-9+/\s]+={0,2}\s*", text)))


def _body(tree: dict, path: str) -> tuple[tuple | None, str | None]:
    """((guard, parsed, chunked), None) of a body that can be masked, else (None, why not)."""
    side, key, _ = path.split(".")
    node = tree.get(side)
    node = node.get(key) if isinstance(node, dict) else None
    text = node.get("text") if isinstance(node, dict) else None
    if not isinstance(text, str) or not text:
        return None, None
    if not _maskable(str(node.get("mimeType") or ""), str(node.get("encoding") or "")):
        return None, f"{path}: not text that is masked"
    if _encoded(text):
        return None, f"{path}: packed or binary"
    guard, inner, chunked = texts.unframe(text)
    try:
        return (guard, texts.parse(inner), chunked), None
    except (ValueError, RecursionError) as problem:
        return None, f"{path}: {problem}"


def _read(text: str) -> tuple[dict, dict, list[str]]:
    """(tree, bodies by path, errors) of an entry."""
    tree = texts.json_tree(text)
    if not isinstance(tree, dict):
        raise ValueError("an entry is an object")
    bodies, errors = {}, []
    for path in _BODIES:
        bodies[path], why = _body(tree, path)
        errors += [why] if why else []
    return tree, bodies, errors


def _usual(node) -> bool:
    """Whether a node is an object without keys that look like more than one step of a path."""
    return type(node) is dict and not any("." in key or "[" in key for key in node)


def _surfaces(tree: dict) -> list[tuple] | None:
    """(object, key, path, section, name) of each value in a section but bodies; None where an entry is built in another way than the
    format says (lists inside strings, keys that look like paths), which takes a walk over all of it."""
    out = []
    if not _usual(tree):
        return None
    for side, lists in _LISTS.items():
        if (node := tree.get(side)) is None:
            continue
        part = node.get(_PART[side]) if _usual(node) else False
        if part is not None and not _usual(part):
            return None
        held = [(node.get(key), f"{side}.{key}", section) for key, section in lists]
        held += [(part.get("params"), "request.postData.params", "param")] if part and side == "request" else []
        for listed, path, section in held:
            if listed is None:
                continue
            if type(listed) is not list:
                return None
            for i, pair in enumerate(listed):
                if type(pair) is not dict:
                    return None
                for key in pair:
                    if key.startswith("value"):
                        if key != "value":
                            return None
                        name = pair.get("name")
                        name = ("true" if name else "false") if isinstance(name, bool) else str(name) if isinstance(name, str) and texts.nested(name) is None else ""
                        out.append((pair, key, f"{path}[{i}].value", section, name))
        url = _URL[side]
        if isinstance(node.get(url), str | bool) and texts.nested(node[url]) is None:
            out.append((node, url, f"{side}.{url}", "url", f"{side}.{url}"))
    if isinstance(tree.get(_ADDRESS), str | bool) and texts.nested(tree[_ADDRESS]) is None:
        out.append((tree, _ADDRESS, _ADDRESS, "ip", _ADDRESS))
    return out


@functools.lru_cache(1 << 16)
def _normal(path: str) -> str:
    return re.sub(r"\[\d+\]", "[]", path)


def _found(text: str) -> tuple[list[tuple], list[str], dict]:
    """(the leaves that have a section, in the order in which rebuild() takes them, as tuples of _FOUND; errors; the tree)."""
    tree, bodies, errors = _read(text)
    surfaces = _surfaces(tree)
    if surfaces is None:
        leaves = [tuple(leaf[field] for field in _FIELDS) for leaf in _walked(tree, bodies) if leaf["section"]]
    else:
        leaves, inner = [], []
        for holder, key, path, section, name in surfaces:
            value = holder[key]
            if type(value) is str and value.lstrip()[:1] not in ("{", "["):
                leaves.append((path, _normal(path), "string", value, section, name))
            else:
                raw._walk(value, path, inner, None)
                leaves += [(x["path"], x["norm_path"], x["kind"], x["value"], section, name) for x in inner]
                inner.clear()
        for body, held in bodies.items():
            leaves += [tuple(leaf[field] for field in _FIELDS) for leaf in _in_body(body, held)] if held else []
    return [(*leaf, raw.by_path_type(leaf[1])) for leaf in leaves], errors, tree


def _in_body(body: str, held: tuple) -> list[dict]:
    inner: list[dict] = []
    for i, doc in enumerate(held[1].documents):
        raw._walk(doc, body + (f"[{i}]" if len(held[1].documents) > 1 else ""), inner, None)
    return [{**x, "section": "body", "name": x["norm_path"][len(body) :].lstrip(".")} for x in inner]


def _walked(tree: dict, bodies: dict) -> list[dict]:
    """All leaves of an entry, of any build, in its order, with section and name."""
    leaves: list[dict] = []
    out: list[dict] = []
    raw._walk(tree, "", leaves, None)
    names = {leaf["path"][: -len(".name")]: leaf["value"] for leaf in leaves if leaf["path"].endswith(".name")}
    seen = set()
    for leaf in leaves:
        path = leaf["path"]
        section, name = "", ""
        body = next((b for b in _BODIES if path == b or path.startswith((f"{b}.", f"{b}["))), None) if path.startswith(_BODIES) else None
        if body and bodies[body]:
            if body not in seen:
                seen.add(body)
                out += _in_body(body, bodies[body])
            continue
        for pattern, kind in _SECTIONS if ".value" in path else ():
            if (found := pattern.match(path)) and path[found.end() :].startswith(".value"):
                section, name = kind, names.get(found[0], "")
        if path in _URLS:
            section, name = "url", path
        elif path == _ADDRESS:
            section, name = "ip", path
        out.append({**leaf, "section": section, "name": name})
    return out


def flatten(entries: DataFrame) -> DataFrame:
    """``entries`` with ``leaves`` (path, norm_path, kind, value, section, name) and ``errors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                try:
                    tree, bodies, errors = _read(text or "")
                    leaves = _walked(tree, bodies)
                except (ValueError, RecursionError) as problem:
                    leaves, errors = None, [str(problem)]
                rows.append({"leaves": leaves, "errors": errors})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("leaves", pa.list_(pa.struct([(n, pa.string()) for n in _FIELDS]))), ("errors", pa.list_(pa.string()))])
    return raw._beside(entries, "text", run, f"leaves array<struct<{','.join(f'{n}:string' for n in _FIELDS)}>>, errors array<string>")


def _whole(leaf: raw.Leaf) -> Column:
    """Whether the leaf is its value as a whole, and not a part of JSON inside it."""
    return leaf["path"].endswith(".value") | leaf["section"].isin("url", "ip")


def _decided(rows: DataFrame, policy: Mapping[str, bool], overrides: list[tuple]) -> DataFrame:
    """Rows of leaves (``__<field>``, ``__by_path``) with ``__type``, that of its fake, ``__default`` and ``__redact``: a leaf's category must be on,
    then an override by (section, name, value) decides, else the default. Each step is a column of its own, so that nothing is
    worked out again wherever it is used."""
    leaf = coded.leaf(_FIELDS)
    section, name, value = leaf["section"], leaf["name"], leaf["value"]
    kind = F.col("__found")
    rows = rows.withColumn("__found", raw.found_type(F.col("__by_path"), leaf))
    rows = rows.withColumn("__secret", F.when((section == "url") | ((section == "body") & (kind == "url")), network.url_has_secrets(value)))
    in_body = F.when(kind == "url", F.col("__secret")).otherwise(~kind.isin("preserve", *KEPT_TYPES))
    part = (leaf["kind"] == "string") & (value != "")
    by_name = network.default_redact(section, name, value) & (_whole(leaf) | part)
    default = F.when(section == "body", in_body).when(section == "url", F.col("__secret")).when(section != "", by_name).otherwise(False)
    on = F.lit(False)
    for of, category in (*har.CATEGORIES.items(), ("url", "params")):
        on = on | (section == of) if policy.get(category, True) else on
    rows = rows.withColumn("__default", default).withColumn("__type", F.when(kind == "preserve", "id").otherwise(kind))
    default = F.col("__default")
    chosen = F.coalesce(_lookup(overrides, 3)[network.target_key(section, name, value)], default) if overrides else default
    return rows.withColumn("__redact", on & chosen)


def _lookup(overrides: Iterable[tuple], what: int) -> Column:
    listed = [x for row in overrides for x in (network.target_key(*(F.lit(v) for v in row[:3])), F.lit(row[what]))]
    return F.create_map(*listed)


def _replaced(seed: Column | str, overrides: list[tuple]) -> Column:
    """What a decided leaf becomes."""
    leaf = coded.leaf((*_FIELDS, "type")) | {"anchor": F.lit(True)}
    section, name, value = leaf["section"], leaf["name"], leaf["value"]
    linked = (section == "url") | ((section == "body") & (leaf["type"] == "url"))
    made = F.when(linked, network.redact_url(value, seed)).when(section == "body", raw.masked_value(leaf, seed)).otherwise(har.replacement(section, name, value, seed))
    if overrides:
        made = F.coalesce(_lookup(overrides, 4)[network.target_key(section, name, value)], made)
    return F.when(F.col("__redact"), made).otherwise(value)


_HELPERS = ("__found", "__secret", "__default", "__type", "__redact")


def _coded(entries: DataFrame, note: str) -> DataFrame:
    def find(text: str | None) -> tuple[list[tuple] | None, list[str]]:
        try:
            leaves, errors, _ = _found(text or "")
        except (ValueError, RecursionError) as problem:
            return None, [str(problem)]
        return leaves, errors

    return coded.coded(coded.reserved(entries, *_HELPERS), "text", find, _FOUND, StructField(note, ArrayType(StringType())))


def redact(entries: DataFrame, seed: str = SEED, policy: Mapping[str, bool] = POLICY, overrides: Iterable[tuple] = ()) -> DataFrame:
    """``entries`` with the text redacted, and ``errors`` (``_errors`` where there is a column of that name); an entry that
    does not parse is null.

    ``policy`` switches headers (with cookies), params (with URLs), bodies and ips. ``overrides`` are rows
    (section, name, value, redact, literal or None), a list as short as a person makes it.
    """
    overrides, note = list(overrides), coded.named(entries, "errors")
    rows = _decided(_coded(entries, note), policy, overrides)
    rows = rows.withColumn("__made", F.when(F.col("__at").isNotNull(), _replaced(seed, overrides)))
    return coded.written(rows, entries.columns, "text", note, rebuild)


def rebuild(text: str, values: list[str]) -> str:
    """The entry with the leaves of its sections replaced, in the order of _found()."""
    tree, bodies, _ = _read(text)
    surfaces = _surfaces(tree)
    if surfaces is None:
        return _rebuilt(tree, bodies, values)
    left = iter(values)
    for holder, key, *_ in surfaces:
        holder[key] = _again(holder[key], left)
    for path, held in bodies.items():
        if held:
            guard, parsed, chunked = held
            parsed.documents = [_again(doc, left) for doc in parsed.documents]
            side, part, key = path.split(".")
            tree[side][part][key] = texts.frame(guard, texts.write(parsed), chunked)
    return texts.json_text(tree)


def _again(node, left: Iterator[str]):
    """A tree with its leaves replaced, in the order of a walk."""
    if isinstance(node, dict):
        return {k: _again(v, left) for k, v in node.items()}
    if isinstance(node, texts.Pairs):
        return texts.Pairs((k, place, _again(v, left)) for k, place, v in node)
    if isinstance(node, list):
        return [_again(v, left) for v in node]
    if node is None:
        return None
    if (inner := texts.nested(node)) is not None:
        return texts.json_text(_again(inner, left))
    value = next(left)
    return (value == "true") if isinstance(node, bool) else texts.Number(value) if isinstance(node, texts.Number) else value


def _rebuilt(tree: dict, bodies: dict, values: list[str]) -> str:
    """rebuild() of an entry of any build, by a walk over all of it."""
    given = iter(values)
    left = iter([next(given) if leaf["section"] else leaf["value"] for leaf in _walked(tree, bodies)])

    def again(node, path: str):
        if bodies.get(path):
            guard, parsed, chunked = bodies[path]
            parsed.documents = [again(doc, f"{path}#") for doc in parsed.documents]
            return texts.frame(guard, texts.write(parsed), chunked)
        if path in bodies and isinstance(node, str):  # not masked: as it is, whatever leaves it counts for
            inner: list[dict] = []
            raw._walk(node, path, inner, None)
            for _ in inner:
                next(left)
            return node
        if isinstance(node, dict):
            return {k: again(v, f"{path}.{k}" if path else k) for k, v in node.items()}
        if isinstance(node, texts.Pairs):
            return texts.Pairs((k, place, again(v, f"{path}.{k}")) for k, place, v in node)
        if isinstance(node, list):
            return [again(v, f"{path}[{i}]") for i, v in enumerate(node)]
        if node is None:
            return None
        if (inner := texts.nested(node)) is not None:
            return texts.json_text(again(inner, path))
        value = next(left)
        return (value == "true") if isinstance(node, bool) else texts.Number(value) if isinstance(node, texts.Number) else value

    return texts.json_text(again(tree, ""))


def values(entries: DataFrame) -> DataFrame:
    """(har_id, entry, section, name, value, method, url) of all surfaces, bodies and URLs too: what har.targets() takes."""
    flat = flatten(entries).withColumn("method", F.get_json_object("text", "$.request.method")).withColumn("url", F.get_json_object("text", "$.request.url"))
    rows = flat.select("har_id", "entry", "method", "url", F.explode("leaves").alias("x")).where("x.section <> ''")
    return rows.select("har_id", "entry", "x.section", "x.name", "x.value", "method", "url")


_VALUE = _FOUND.index("value")
_PLACE = "struct<har_id:string,entry:bigint,method:string,url:string>"


def _occurrences(entries: DataFrame, count: int) -> DataFrame:
    """(__<field>, n, places): of each batch's distinct targets how often they stand there, and the first ``count`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for har_id, entry, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                try:
                    leaves, _, tree = _found(text or "")
                except (ValueError, RecursionError):
                    continue
                request = tree.get("request") if isinstance(tree.get("request"), dict) else {}
                method, url = (str(request[k]) if isinstance(request.get(k), str) else None for k in ("method", "url"))
                place = {"har_id": har_id, "entry": entry, "method": method, "url": url}
                for leaf in leaves:
                    if leaf[_VALUE]:
                        held = found.setdefault(leaf, [0, {}])
                        held[0] += 1
                        held[1][har_id, entry] = place
            rows = [(*key, n, [places[k] for k in sorted(places, key=_least)[:count]]) for key, (n, places) in found.items()]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    text = [(f"__{field}", pa.string()) for field in _FOUND]
    schema = pa.schema([*text, ("n", pa.int64()), ("places", pa.list_(pa.struct([("har_id", pa.string()), ("entry", pa.int64()), ("method", pa.string()), ("url", pa.string())])))])
    ddl = ", ".join(f"{name} string" for name, _ in text) + f", n long, places array<{_PLACE}>"
    return entries.select(F.col("har_id").cast("string"), F.col("entry").cast("long"), "text").mapInArrow(run, ddl)


def _least(place: tuple) -> tuple:
    return tuple((x is None, x if x is not None else "") for x in place)


_FLAGS = ("default", "redact")
#: Targets of a batch of what is written out.
_OUT = 2_000


def _merged(batches: Iterator[pa.RecordBatch], locations: int) -> Iterator[pa.RecordBatch]:
    """Targets of rows that come in the order of their keys; a row a target, many a batch."""
    place = pa.struct([("har_id", pa.string()), ("entry", pa.int64()), ("method", pa.string()), ("url", pa.string())])
    schema = pa.schema([
        *((c, pa.string()) for c in ("target_key", "section", "name", "original", "replacement")), *((c, pa.bool_()) for c in _FLAGS), ("reason", pa.string()), ("occurrences", pa.int64()), ("locations", pa.list_(place)),
    ])
    now: dict | None = None
    held: dict = {}
    done: list[dict] = []

    def close() -> None:
        now["locations"] = [held[k] for k in sorted(held, key=_least)[:locations]]
        done.append(now)

    for batch in batches:
        for row in batch.to_pylist():
            n, places = row.pop("n"), row.pop("places")
            if now is None or now["target_key"] != row["target_key"]:
                if now is not None:
                    close()
                    if len(done) >= _OUT:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done.clear()
                now, held = {**row, "occurrences": 0}, {}
            else:
                now["reason"] = min((not x["default"], x["reason"]) for x in (now, row))[1]
                if row["redact"] and not now["redact"]:
                    now["replacement"] = row["replacement"]
                now |= {flag: now[flag] or row[flag] for flag in _FLAGS}
            now["occurrences"] += n
            for p in places:
                held[p["har_id"], p["entry"]] = p
            if len(held) > 10 * locations:
                held = {k: held[k] for k in sorted(held, key=_least)[:locations]}
    if now is not None:
        close()
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def targets(entries: DataFrame, policy: Mapping[str, bool] = POLICY, overrides: Iterable[tuple] = (), seed: str = SEED, locations: int = har.LOCATIONS) -> DataFrame:
    """(target_key, section, name, original, replacement, default, redact, reason, occurrences, locations): one row a target, over all
    surfaces, bodies and URLs too. ``locations`` are its first entries by (har_id, entry), 20 at most; original and replacement
    are cut at 512 characters; ``reason`` says why it is redacted or kept by default.

    Each batch counts its targets and keeps their first entries; these rows are shuffled once, by target, and merged in a
    stream, so that a header of every entry costs one row a batch and its task holds twenty places, not all."""
    overrides = list(overrides)
    section, name, value = F.col("__section"), F.col("__name"), F.col("__value")
    rows = _decided(_occurrences(entries, locations), policy, overrides)
    made = rows.withColumn("__made", _replaced(seed, overrides)).select(
        network.target_key(section, name, value).alias("target_key"), section.alias("section"), name.alias("name"), truncated(value, har.SHOWN).alias("original"),
        truncated(F.col("__made"), har.SHOWN).alias("replacement"), F.col("__default").alias("default"), F.col("__redact").alias("redact"),
        reason(section, F.col("__found"), F.col("__default")).alias("reason"), "n", "places",
    )
    dealt = made.repartition("target_key").sortWithinPartitions("target_key", F.col("name"))
    return dealt.mapInArrow(lambda batches: _merged(batches, locations), f"target_key string, section string, name string, original string, replacement string, default boolean, redact boolean, reason string, occurrences long, locations array<{_PLACE}>")


def reason(section: Column, kind: Column, default: Column) -> Column:
    """Why something is redacted or kept by default, in a few words: by section, in bodies by the type that was found."""
    words = F.coalesce(F.create_map(*map(F.lit, itertools.chain.from_iterable(KIND_WORDS.items())))[kind], F.lower(F.regexp_replace(kind, "([A-Z])", " $1")))
    in_body = (
        F.when(kind == "url", F.when(default, REASONS["url"][0]).otherwise(REASONS["url"][1])).when(kind.isin(*KEPT_TYPES), words).when(default, words)
        .otherwise("nothing personal found")
    )
    named = F.lit(None).cast("string")
    for of, (redacted, kept) in REASONS.items():
        named = F.when(section == of, F.when(default, redacted).otherwise(kept)).otherwise(named)
    return F.when(section == "body", in_body).otherwise(named)


#: What the format requires of an entry, by kind; a part that is missing or of another kind is reported, and nothing below it.
REQUIRED = {
    "OBJECT": ("cache", "timings", "request", "response", "response.content"),
    "STRING": (
        "startedDateTime", "request.method", "request.url", "request.httpVersion", "response.statusText", "response.httpVersion", "response.redirectURL", "response.content.mimeType",
    ),
    "NUMBER": (
        "time", "timings.send", "timings.wait", "timings.receive", "request.headersSize", "request.bodySize", "response.status", "response.headersSize", "response.bodySize", "response.content.size",
    ),
    "PAIRS": ("request.headers", "request.cookies", "request.queryString", "response.headers", "response.cookies"),
}


def violations(text: Column) -> Column:
    """The paths of an entry's text that are not what the format requires, in the order of REQUIRED: objects, strings and numbers
    that are missing or of another kind, a body's text that is no string, lists of pairs that are no lists, and their elements that are no
    {name, value} of strings (``request.headers[2]``). A text that is null, no JSON object or has a key twice is ``$`` alone.

    The text is parsed once, into a variant; each check is a look at one path of it."""
    number = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"

    def kind(node: Column, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(node, path, "variant")), F.lit("VOID"))

    def is_a(node: Column, path: str, wanted: str) -> Column:
        found = kind(node, path)
        return found.startswith("OBJECT") if wanted == "OBJECT" else found.rlike(number) if wanted == "NUMBER" else found == "STRING"

    def pairs(root: Column, path: str) -> Column:
        listed = F.try_variant_get(root, f"$.{path}", "array<variant>")
        numbered = F.transform(listed, lambda x, i: F.when(~(is_a(x, "$.name", "STRING") & is_a(x, "$.value", "STRING")), F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))))
        return F.when(listed.isNull(), F.array(F.lit(path))).otherwise(F.filter(numbered, lambda x: x.isNotNull()))

    def checked(root: Column) -> Column:
        def below(path: str, found: Column) -> Column:
            parent = path.rpartition(".")[0]
            return F.when(is_a(root, f"$.{parent}", "OBJECT"), found) if parent else found

        plain = [below(path, F.when(~is_a(root, f"$.{path}", wanted), path)) for wanted in ("OBJECT", "STRING", "NUMBER") for path in REQUIRED[wanted]]
        body = F.when(~kind(root, "$.response.content.text").isin("STRING") & F.try_variant_get(root, "$.response.content.text", "variant").isNotNull(), "response.content.text")
        none = F.array().cast("array<string>")
        lists = [F.coalesce(below(path, pairs(root, path)), none) for path in REQUIRED["PAIRS"]]
        return F.when(is_a(root, "$", "OBJECT"), F.concat(F.filter(F.array(*plain, body), lambda x: x.isNotNull()), *lists)).otherwise(F.array(F.lit("$")))

    # Bound to a lambda's variable, so that the text is parsed once and not for each check.
    return F.element_at(F.transform(F.array(F.try_parse_json(text)), checked), 1)


def write(entries: DataFrame, folder: str) -> None:
    """Entries as lines below ``folder``, by log and in their order within each file."""
    ordered = entries.repartitionByRange("har_id", "entry").sortWithinPartitions("har_id", "entry")
    ordered.select("har_id", F.col("text").alias("value")).write.partitionBy("har_id").text(folder)
