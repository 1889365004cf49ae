"""DuckDB SQL for the expression layer: the independent side of the oracles."""

from __future__ import annotations

from maskframe.functions import detect, fakes, network
from maskframe.functions.hashing import SEED


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(options: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(quoted, options)) + "]"


def among(options: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(quoted, options)) + ")"


def digest(kind: str, value: str, salt: str = "''", part: int = 0, seed: str = SEED) -> str:
    return f"md5(concat_ws(chr(1), {quoted(seed)}, {quoted(kind)}, CAST({value} AS VARCHAR), CAST({salt} AS VARCHAR), '{part}'))"


def number(hexes: str, at: int = 1, width: int = 8) -> str:
    return f"(('0x' || substr({hexes}, {at}, {width}))::BIGINT)"


def scramble(value: str, salt: str = "''", kind: str = "id", seed: str = SEED) -> str:
    blocks = " || ".join(digest(kind, value, salt, part, seed) for part in range(4))
    r = f"(('0x' || substr({blocks}, 1 + 2 * ((i - 1) % 64), 2))::INT)"
    c = f"substr({value}, i, 1)"
    return f"""array_to_string(list_transform(range(1, length({value}) + 1), lambda i: CASE
      WHEN {c} BETWEEN '0' AND '9' AND i = 1 AND {c} <> '0' THEN chr((49 + (ascii({c}) - 49 + 1 + {r} % 8) % 9)::INT)
      WHEN {c} BETWEEN '0' AND '9' AND i = 1 THEN '0'
      WHEN {c} BETWEEN '0' AND '9' THEN chr((48 + (ascii({c}) - 48 + 1 + {r} % 9) % 10)::INT)
      WHEN {c} BETWEEN 'a' AND 'z' THEN chr((97 + (ascii({c}) - 97 + 1 + {r} % 25) % 26)::INT)
      WHEN {c} BETWEEN 'A' AND 'Z' THEN chr((65 + (ascii({c}) - 65 + 1 + {r} % 25) % 26)::INT)
      ELSE {c} END), '')"""


def whole_number(value: str, kind: str = "id") -> str:
    """Non-negative numbers of up to nine digits."""
    size = f"length(CAST({value} AS VARCHAR))"
    low, key = f"CASE WHEN {size} = 1 THEN 0 ELSE CAST(pow(10, {size} - 1) AS BIGINT) END", digest(kind, size)
    return f"""({low}) + (({value} - ({low})) * (30 * ({number(key, 1, 7)} % 1000000) + 1) + 30 * ({number(key, 9, 7)} % 1000000) + 7)
      % (CASE WHEN {size} = 1 THEN 10 ELSE 9 * CAST(pow(10, {size} - 1) AS BIGINT) END)"""


def pick(options: tuple[str, ...], at: str) -> str:
    return f"list_extract({listed(options)}, CAST(({at}) % {len(options)} + 1 AS INT))"


def other_pick(options: tuple[str, ...], at: str, value: str) -> str:
    first = pick(options, at)
    return f"CASE WHEN lower({first}) = lower({value}) THEN {pick(options, at + ' + 1')} ELSE {first} END"


def in_case(made: str, value: str) -> str:
    return f"CASE WHEN lower({value}) = upper({value}) THEN {made} WHEN {value} = lower({value}) THEN lower({made}) WHEN {value} = upper({value}) THEN upper({made}) ELSE {made} END"


def fake(kind: str, value: str, salt: str = "''", parent: str = "''") -> str:
    """Values that are neither null nor empty."""
    key = digest(kind, value, salt)
    h, g = number(key), number(key, 9)
    other = lambda options: f"({in_case('(' + other_pick(options, h, value) + ')', value)})"
    names, codes = (lambda pairs: tuple(n for n, _ in pairs)), (lambda pairs: tuple(c for _, c in pairs))
    long = f"(regexp_full_match({value}, '[A-Z]{{3}}|[a-z]{{3}}'))"
    place = lambda pairs, wide: f"CASE WHEN length({value}) = 2 THEN {other(codes(pairs))} WHEN {long} THEN {wide} ELSE {other(names(pairs))} END"
    front = f"regexp_extract({value}, '^([A-Z]{{1,3}}-)[0-9A-Za-z]', 1)"
    row = f"CAST({number(digest(kind.removesuffix('Code').removesuffix('Message'), quoted(''), parent))} % {len(fakes.CHECK_RESULTS)} + 1 AS INT)"
    words = lambda n, width: " || ' ' || ".join(pick(fakes.WORDS, number(key, 1 + width * k, width)) for k in range(n))
    titled = lambda word: f"(upper(substr({word}, 1, 1)) || substr({word}, 2))"
    currency = other_pick(fakes.CURRENCIES, h, value)
    made = {
        "phone": scramble(value, salt, "phone"), "sku": scramble(value, salt, "sku"),
        "postalCode": f"{front} || {scramble(f'substr({value}, length({front}) + 1)', salt, 'postalCode')}",
        "uuid": " || '-' || ".join(f"substr({key}, {at}, {width})" for at, width in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))), "firstName": other_pick(fakes.FIRST_NAMES, h, value),
        "lastName": other_pick(fakes.LAST_NAMES, h, value), "company": other_pick(fakes.COMPANIES, h, value),
        "productName": f"{titled(pick(fakes.WORDS, h))} || ' ' || {titled(pick(fakes.WORDS, g))}",
        "street": in_case(f"(({h} % 899 + 100) || ' ' || {pick(fakes.STREETS, g)})", value), "streetSecondary": in_case(f"('Unit ' || ({h} % 899 + 100))", value), "city": other(fakes.CITIES),
        "state": place(fakes.STATES, scramble(value, salt, "state")), "stateOrProvince": place(fakes.STATES, scramble(value, salt, "stateOrProvince")),
        "country": place(fakes.COUNTRIES, other(fakes.LONG_CODES)), "countryCode": f"CASE WHEN {long} THEN {other(fakes.LONG_CODES)} ELSE {other(codes(fakes.COUNTRIES))} END",
        "currency": f"CASE WHEN {value} = lower({value}) THEN lower({currency}) ELSE {currency} END", "url": f"'https://example.com/' || substr({key}, 1, 12)",
        "isoDate": f"strftime(CAST(substr({value}, 1, 10) AS DATE) - CAST({h} % 700 + 1 AS INT), '%Y-%m-%d') || substr({value}, 11)",
        "birthDate": f"strftime(CAST(substr({value}, 1, 10) AS DATE) - CAST({h} % 700 + 1 AS INT), '%Y-%m-%d') || substr({value}, 11)",
        "shortText": words(3, 4), "longText": words(10, 3) + " || '.'",
        **{f"{k}Code": f"list_extract({listed(codes([(m, c) for c, m in fakes.CHECK_RESULTS]))}, {row})" for k in ("cvv", "avs")},
        **{f"{k}Message": f"list_extract({listed(codes(fakes.CHECK_RESULTS))}, {row})" for k in ("cvv", "avs")},
    }
    return f"({made[kind]})"


def amount(value: str, salt: str = "''") -> str:
    cents = f"CAST(floor(abs({value}) * 100) AS BIGINT)"
    share = f"({number(digest('priceAmount', cents, salt))} % 900 + 100)"
    made = f"((CAST(floor({cents} * {share} / 1000) AS BIGINT) + 1) / 100)"
    return f"CASE WHEN {value} < 0 THEN -{made} ELSE {made} END"


def full_name(value: str, salt: str = "''") -> str:
    key = digest("fullName", value, salt)
    first, n = pick(fakes.FIRST_NAMES, number(key)), f"split_part({value}, ' ', 1)"
    return f"(CASE WHEN lower({first}) = lower({n}) THEN {pick(fakes.FIRST_NAMES, number(key) + ' + 1')} ELSE {first} END || ' ' || {pick(fakes.LAST_NAMES, number(key, 9))})"


def luhn(value: str) -> str:
    digit = f"(ascii(substr({value}, length({value}) - i + 1, 1)) - 48)"
    return f"list_sum(list_transform(range(1, length({value}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"


def value_type(v: str) -> str:
    found = lambda p: f"regexp_matches({v}, {quoted(p)})"
    digits = f"length(regexp_replace({v}, '[^0-9]', '', 'g'))"
    return f"""CASE WHEN {found(detect.EMAIL)} THEN 'email' WHEN {found(detect.JWT)} THEN 'id' WHEN {found(detect.UUID)} THEN 'uuid' WHEN {found(detect.LONG_HEX)} THEN 'id'
      WHEN {found(detect.IPV4)} THEN 'ipv4' WHEN {found(detect.URL)} THEN 'url' WHEN {found(detect.ISO_DATE)} THEN 'isoDate'
      WHEN {found(detect.CARD)} AND {luhn(v)} THEN 'redact'
      WHEN {found(detect.PHONE)} AND {found('[+ ().-]')} AND {digits} BETWEEN 7 AND 15 THEN 'phone' ELSE 'preserve' END"""


def path_type(path: str) -> str:
    last = f"regexp_extract({path}, '([A-Za-z0-9_]+)(?:\\[[0-9]+\\])?$', 1)"
    plain, snaked = f"lower({last})", f"lower(regexp_replace({last}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"

    def keyed(name: str) -> str:
        whens = " ".join(f"WHEN {name} IN {among(keys)} THEN {quoted(kind)}" for kind, keys in detect.KEYS.items())
        return f"CASE WHEN {name} IN {among(detect.ID_KEYS)} OR regexp_matches({name}, '(?:{'|'.join(detect.ID_ENDINGS)})$') THEN 'id' {whens} END"

    paired = " ".join(f"WHEN ends_with(lower({path}), {quoted(end)}) THEN {quoted(kind)}" for end, kind in detect.PAIRED.items())
    return f"""CASE {paired} WHEN {plain} IN {among(detect.HANDLE_KEYS)} OR {snaked} IN {among(detect.HANDLE_KEYS)} THEN 'handle'
      WHEN {keyed(plain)} IS NOT NULL THEN {keyed(plain)} WHEN {keyed(snaked)} IS NOT NULL THEN {keyed(snaked)} WHEN {plain} = 'name' THEN 'name' END"""


def detect_type(path: str, v: str, kind: str) -> str:
    named = f"CASE WHEN regexp_matches(trim({v}), {quoted(detect.PERSON)}) THEN 'fullName' WHEN length(trim({v})) >= 5 AND NOT regexp_matches(trim({v}), '\\s') AND regexp_matches(trim({v}), '[_0-9]') THEN 'id' END"
    rest = f"CASE WHEN {kind} = 'string' THEN {value_type(v)} ELSE 'preserve' END"
    looks = f"CASE WHEN {kind} = 'string' THEN length({v}) >= 4 AND NOT regexp_matches({v}, '^[a-z]+(?:[-_][a-z]+)*$') ELSE coalesce(try_cast({v} AS DOUBLE) >= 1000, false) END"
    p = path_type(path)
    return f"""CASE WHEN {kind} = 'string' AND lower(trim({v})) IN {among(detect.PLACEHOLDERS)} THEN 'preserve' WHEN ({p}) = 'handle' THEN 'id'
      WHEN ({p}) = 'id' AND NOT {looks} THEN 'preserve'
      WHEN ({p}) = 'name' THEN coalesce(CASE WHEN {kind} = 'string' THEN {named} END, {rest}) WHEN ({p}) IS NOT NULL THEN ({p}) ELSE {rest} END"""


def secret_param(name: str) -> str:
    snaked = f"lower(regexp_replace(trim({name}), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
    return f"(lower(trim({name})) = 'code' OR regexp_matches(lower(trim({name})), {quoted(network.SECRET_PARAM)}) OR regexp_matches({snaked}, {quoted(network.SECRET_PARAM)}))"


def looks_like_token(v: str) -> str:
    mixed = f"len(list_filter(regexp_extract_all({v}, '[A-Za-z0-9]{{16,}}'), lambda r: regexp_matches(r, '[A-Za-z]') AND regexp_matches(r, '[0-9]'))) > 0"
    return f"(length(trim({v})) >= 16 AND NOT regexp_matches(trim({v}), '^[hH][tT][tT][pP][sS]?://') AND (regexp_matches(trim({v}), {quoted(network.UUID)}) OR {mixed}))"


def url_has_secrets(url: str) -> str:
    pairs = f"list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"
    return f"(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)@', 1) <> '' OR len(list_filter({pairs}, lambda p: {secret_param("split_part(p, '=', 1)")})) > 0)"


def redact_url(url: str) -> str:
    """URLs without a user."""
    name, value = "split_part(p, '=', 1)", "substr(p, length(split_part(p, '=', 1)) + 2)"
    pair = f"CASE WHEN {secret_param(name)} AND {value} <> '' THEN {name} || '=' || {scramble(value)} ELSE p END"
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    masked = f"array_to_string(list_transform(string_split({query}, '&'), lambda p: {pair}), '&')"
    return f"CASE WHEN {url_has_secrets(url)} THEN regexp_extract({url}, '^([^?#]*)', 1) || '?' || {masked} || regexp_extract({url}, '(#.*)$', 1) ELSE {url} END"


def default_redact(section: str, name: str, v: str) -> str:
    secret_header = f"(lower(trim({name})) IN {among(network.SECRET_HEADERS)} OR regexp_matches(lower(trim({name})), {quoted(network.SECRET_HEADER)}))"
    return f"""CASE WHEN {section} = 'header' AND lower({name}) IN {among(network.LINK_HEADERS)} THEN {url_has_secrets(v)} WHEN {section} = 'header' THEN {secret_header}
      WHEN {section} = 'cookie' THEN regexp_matches(lower(trim({name})), {quoted(network.SENSITIVE_COOKIE)}) OR {looks_like_token(v)}
      WHEN {section} = 'param' THEN {secret_param(name)} OR {looks_like_token(v)} WHEN {section} = 'ip' THEN NOT regexp_matches(lower(trim({v})), {quoted(network.PRIVATE_IP)}) ELSE false END"""


def replacement(section: str, name: str, v: str) -> str:
    word = f"regexp_extract({v}, '^([A-Za-z][A-Za-z0-9_-]*\\s+)\\S', 1)"
    ip = digest("ipv4", v)
    return f"""CASE WHEN {section} = 'header' AND lower({name}) IN {among(network.LINK_HEADERS)} THEN {redact_url(v)}
      WHEN {section} = 'header' AND lower({name}) IN ('authorization', 'proxy-authorization') THEN {word} || {scramble(f"substr({v}, length({word}) + 1)")}
      WHEN {section} = 'ip' THEN {pick(("192.0.2", "198.51.100", "203.0.113"), number(ip))} || '.' || ({number(ip, 9)} % 254 + 1) ELSE {scramble(v)} END"""


def target_key(section: str, name: str, v: str) -> str:
    return f"md5(concat_ws(chr(1), {section}, CASE WHEN {section} = 'header' THEN lower({name}) ELSE {name} END, {v}))"
