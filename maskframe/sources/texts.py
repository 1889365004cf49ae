"""Payload texts as trees and back in their own format: JSON, NDJSON, XML, CSV, forms and base64-wrapped XML.

A tree is made of dicts, lists, strings, booleans, None, and numbers kept as their own text (``Number``).
These are per-row helpers of the raw lane; Spark deals out the rows.
"""

from __future__ import annotations

import base64
import csv
import io
import itertools
import json
import re
from collections import Counter
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

# ---- Fixed values: names of the format ----
FORBIDDEN = ("__proto__", "constructor", "prototype")
ATTRIBUTE, TEXT = "@_", "#text"
SIGNATURE, PAYLOAD = "bt_signature", "bt_payload"
# ---- End of fixed values ----
PLACEHOLDER = "masked|signature"


class Number(str):
    """A number's own text."""


class Pairs(list):
    """An object whose keys repeat out of order: (key, place among its kind or None, node), in order."""


@dataclass
class Parsed:
    """The documents of a text, and what is needed to write them again."""

    format: str
    documents: list
    state: dict = field(default_factory=dict)


def _kept(items: list[tuple]) -> dict:
    found = dict(items)
    for name in FORBIDDEN:
        if name in found:
            del found[name]
    return found


_decoder = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=Number, object_pairs_hook=_kept)


def json_tree(text: str):
    """JSON with numbers as their text; the last of repeated keys counts, forbidden keys are dropped."""
    if text.startswith("\ufeff"):
        raise json.JSONDecodeError("Unexpected UTF-8 BOM (decode using utf-8-sig)", text, 0)
    return _decoder.decode(text)


_quoted = json.encoder.encode_basestring


def json_text(node) -> str:
    """Compact JSON of a tree."""
    kind = type(node)
    if kind is str:
        return _quoted(node)
    if kind is dict:
        return "{" + ",".join([f"{_quoted(k)}:{json_text(v)}" for k, v in node.items()]) + "}"
    if isinstance(node, Number):
        return str(node)
    if isinstance(node, list):
        return "[" + ",".join(map(json_text, node)) + "]"
    return "null" if node is None else "true" if node is True else "false" if node is False else json.dumps(node)


def _json(text: str) -> Parsed:
    try:
        return Parsed("json", [json_tree(text)])
    except ValueError as first:
        lines = [line for line in text.splitlines() if line.strip()]
        if len(lines) < 2:
            raise
        try:
            return Parsed("ndjson", [json_tree(line) for line in lines])
        except ValueError:
            raise first from None


def xml_tree(text: str) -> tuple[str, object]:
    """(root tag, tree): attributes under ``@_name``, text under ``#text``; a repeated tag becomes a list."""
    stack: list[tuple[list, list[str]]] = [([], [])]

    def start(tag: str, attributes: dict) -> None:
        stack.append(([(ATTRIBUTE + k, v) for k, v in attributes.items()], []))

    def end(tag: str) -> None:
        children, words = stack.pop()
        text = "".join(words).strip()
        if tag not in FORBIDDEN:
            stack[-1][0].append((tag, _element(children + [(TEXT, text)] * bool(text)) if children else text))

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: stack[-1][1].append(data)
    try:
        parser.Parse(text, True)
    except expat.ExpatError as error:
        raise ValueError(f"xml: {error}") from None
    ((tag, tree),) = stack[0][0]
    return tag, tree


def _element(children: list[tuple]) -> dict | Pairs:
    """Repeated tags side by side become a list; where others stand between them, all stay in their order."""
    runs = [(key, [value for _, value in some]) for key, some in itertools.groupby(children, key=lambda child: child[0])]
    if len({key for key, _ in runs}) == len(runs):
        return {key: values[0] if len(values) == 1 else values for key, values in runs}
    count, place = Counter(key for key, _ in children), Counter()
    out = Pairs()
    for key, value in children:
        out.append((key, place[key] if count[key] > 1 else None, value))
        place[key] += 1
    return out


def xml_text(tag: str, node) -> str:
    """An element of a tree."""
    if isinstance(node, list) and not isinstance(node, Pairs):
        return "".join(xml_text(tag, item) for item in node)
    if not isinstance(node, dict | Pairs):
        return f"<{tag}>{escape(str(node))}</{tag}>" if node not in ("", None) else f"<{tag}/>"
    items = [(k, v) for k, _, v in node] if isinstance(node, Pairs) else list(node.items())
    attributes = "".join(f" {k[len(ATTRIBUTE) :]}={quoteattr(str(v))}" for k, v in items if k.startswith(ATTRIBUTE))
    inner = "".join(escape(str(v)) for k, v in items if k == TEXT) + "".join(xml_text(k, v) for k, v in items if k != TEXT and not k.startswith(ATTRIBUTE))
    return f"<{tag}{attributes}>{inner}</{tag}>" if inner else f"<{tag}{attributes}/>"


def _xml(text: str, state: dict | None = None) -> Parsed:
    tag, tree = xml_tree(text)
    return Parsed("xml", [{tag: tree}], {"declared": text.lstrip().startswith("<?xml"), **(state or {})})


def _unwrapped(packed: str) -> str | None:
    """The XML inside a base64 text, or None."""
    try:
        inner = base64.b64decode(re.sub(r"\s", "", packed), validate=True).decode()
    except ValueError:
        return None
    return inner if inner.lstrip().startswith("<") else None


def _form(text: str) -> Parsed:
    listed = parse_qsl(text, keep_blank_values=True)
    pairs = dict(listed)
    inner = _unwrapped(pairs[PAYLOAD].replace(" ", "+")) if PAYLOAD in pairs else _unwrapped(text)
    if inner is not None:
        return _xml(inner, {"wrapper": "form" if PAYLOAD in pairs else "bare"})
    if "=" not in text:
        raise ValueError("neither a form nor wrapped XML")
    return Parsed("form", [_record(listed)])


def _record(listed: list[tuple[str, str]]) -> dict | Pairs:
    """Named cells without forbidden names; names that repeat keep all their cells."""
    kept = [(k, v) for k, v in listed if k not in FORBIDDEN]
    return dict(kept) if len(dict(kept)) == len(kept) else Pairs((k, None, v) for k, v in kept)


def delimiter_of(header: str) -> str:
    """The delimiter that stands most often outside quotes; of equal ones tab, then semicolon, then comma."""
    bare = re.sub('"(?:[^"]|"")*"', "", header)
    return max("\t;,", key=bare.count)


def _csv(text: str) -> Parsed:
    text = text.lstrip("\ufeff")
    mark = delimiter_of(text.split("\n", 1)[0])
    rows = [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=mark) if any(cell != "" for cell in row)]
    names = rows[0]
    documents = [_record(list(zip(names, [*row, *[""] * len(names)], strict=False))) for row in rows[1:]]
    return Parsed("csv", [documents], {"names": [n for n in names if n not in FORBIDDEN], "mark": mark, "end": "\r\n" if "\r\n" in text else "\n"})


def _is_csv(text: str) -> bool:
    lines = [line for line in re.split(r"\r?\n", text) if line][:2]
    bare = [re.sub('"(?:[^"]|"")*"', "", line) for line in lines]
    return len(bare) == 2 and any(bare[0].count(m) >= 1 and bare[0].count(m) == bare[1].count(m) for m in ",\t;")


def parse(text: str) -> Parsed:
    """The documents of a text of any known format; an error if it has none."""
    body = text.strip("\ufeff \t\r\n")
    if not body:
        return Parsed("blank", [])
    if body[0] == "<":
        return _xml(body)
    if body[0] not in '{["':
        if re.match(r"[A-Za-z0-9_.\-+%\[\]]+=", body) or (len(body) > 64 and re.fullmatch(r"[A-Za-z0-9+/\s]+={0,2}", body)):
            return _form(body)
        if _is_csv(body):
            return _csv(text)
    return _json(body)


def write(parsed: Parsed) -> str:
    """The text of documents in their format."""
    docs, state = parsed.documents, parsed.state
    if parsed.format == "xml":
        ((tag, tree),) = docs[0].items()
        text = ('<?xml version="1.0" encoding="UTF-8"?>\n' if state["declared"] else "") + xml_text(tag, tree)
        if "wrapper" not in state:
            return text
        packed = base64.b64encode(text.encode()).decode()
        return packed if state["wrapper"] == "bare" else urlencode({SIGNATURE: PLACEHOLDER, PAYLOAD: packed})
    if parsed.format == "form":
        return urlencode([(k, v) for k, _, v in docs[0]] if isinstance(docs[0], Pairs) else docs[0])
    if parsed.format == "csv":
        quoted = lambda cell: '"' + cell.replace('"', '""') + '"' if re.search('["\r\n\t,;]', cell) else cell
        cells = lambda row: [str(v) for _, _, v in row] if isinstance(row, Pairs) else [str(row.get(n, "")) for n in state["names"]]
        lines = [state["names"], *map(cells, docs[0])]
        return state["end"].join(state["mark"].join(map(quoted, line)) for line in lines) + state["end"]
    return "\n".join(map(json_text, docs))


def nested(value) -> object | None:
    """The object or array that a string holds as JSON, or None."""
    if not isinstance(value, str) or isinstance(value, Number) or value.lstrip()[:1] not in ("{", "["):
        return None
    try:
        found = json_tree(value)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict | list) else None


GUARD = re.compile(r"\)\]\}'[,\s]*")


def unframe(text: str) -> tuple[str, str, bool]:
    """(guard prefix, body, whether it came in HTTP chunks); what is not framed right stays as it is."""
    body, at, chunks = text.encode(), 0, []
    while head := re.compile(rb"([0-9A-Fa-f]{1,8})(?:;[^\r\n]*)?\r\n").match(body, at):
        size = int(head[1], 16)
        if not size:
            if body[head.end() :].strip():
                break
            text = b"".join(chunks).decode("utf-8", "replace")
            guard = GUARD.match(text)
            return (guard[0] if guard else ""), text[len(guard[0]) if guard else 0 :], True
        if body[head.end() + size : head.end() + size + 2] != b"\r\n":
            break
        chunks.append(body[head.end() : head.end() + size])
        at = head.end() + size + 2
    guard = GUARD.match(text)
    return (guard[0] if guard else ""), text[len(guard[0]) if guard else 0 :], False


def frame(guard: str, body: str, chunked: bool) -> str:
    """What unframe() took apart, with a new body."""
    whole = guard + body
    return f"{len(whole.encode()):x}\r\n{whole}\r\n0\r\n\r\n" if chunked else whole
