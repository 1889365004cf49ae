"""Shape-preserving fakes as Column expressions.

``fake(kind, value, ...)`` gives a string or number of the same kind as its input: digits stay digits,
letters keep their case, lengths and separators stay, numbers keep their digit count, dates their form.
A fake never equals its input; empty strings, nulls and strings without a letter or digit stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.hashing import SEED, digest, number

FIRST_NAMES = ("Ada", "Ben", "Cora", "Dario", "Edith", "Felix", "Greta", "Hugo", "Iris", "Jonas", "Kira", "Leon", "Mara", "Nils", "Olga", "Pablo")
LAST_NAMES = ("Abel", "Brandt", "Castro", "Dietz", "Engel", "Fabre", "Garcia", "Holm", "Ivers", "Jensen", "Koch", "Lang", "Moreau", "Novak", "Ortiz", "Petit")
CITIES = ("Ashford", "Brookdale", "Clayton", "Dunmore", "Eastvale", "Fairview", "Glenwood", "Harlow")
STREETS = ("Alder Way", "Birch Lane", "Cedar Road", "Dogwood Drive", "Elm Street", "Fir Court", "Grove Avenue", "Hazel Close")
COMPANIES = ("Acorn Works", "Bluefield Ltd", "Cobalt Group", "Driftwood Inc", "Evergreen Co", "Foxglove Labs", "Granite Partners", "Harbor Goods")
COUNTRIES = (("Austria", "AT"), ("Belgium", "BE"), ("Canada", "CA"), ("Denmark", "DK"), ("Estonia", "EE"), ("Finland", "FI"), ("Greece", "GR"), ("Hungary", "HU"))
LONG_CODES = ("AUT", "BEL", "CAN", "DNK", "EST", "FIN", "GRC", "HUN")
STATES = (("Alberta", "AB"), ("Bavaria", "BY"), ("Colorado", "CO"), ("Delaware", "DE"), ("Florida", "FL"), ("Georgia", "GA"), ("Idaho", "ID"), ("Kansas", "KS"))
CURRENCIES = ("CHF", "CZK", "DKK", "EUR", "GBP", "NOK", "PLN", "SEK")
WORDS = ("amber", "basin", "cloud", "delta", "ember", "field", "grain", "hill", "inlet", "jade", "kelp", "lake", "moss", "night", "oak", "pine")
#: Codes and messages that belong together: picked by the parent path, so that both come from one row.
CHECK_RESULTS = (("M", "match"), ("N", "no match"), ("P", "not processed"), ("S", "should be present"), ("U", "issuer unavailable"))
REDACTED = "[REDACTED]"


def pick(options: tuple[str, ...], at: Column) -> Column:
    """An entry of a fixed list."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(at, F.lit(len(options))) + 1).cast("int"))


def other_pick(options: tuple[str, ...], at: Column, value: Column) -> Column:
    """An entry that is not the value, ignoring case: the next one instead."""
    first = pick(options, at)
    return F.when(F.lower(first) == F.lower(value), pick(options, at + 1)).otherwise(first)


def in_case(made: Column, value: Column) -> Column:
    """``made`` in lower or upper case where the value is written so; a value without letters of case decides nothing."""
    lower, upper = F.lower(value), F.upper(value)
    return F.when(lower == upper, made).when(value == lower, F.lower(made)).when(value == upper, F.upper(made)).otherwise(made)


def postal_code(value: Column, seed: Column | str = SEED, salt: Column | str = "") -> Column:
    """Another code of the same pattern: letters, digits, blanks, hyphens and a leading zero stay what and where they are, and so
    does a country's prefix of one to three capital letters before a hyphen (``D-10115``)."""
    prefix = F.regexp_extract(value, r"^([A-Z]{1,3}-)[0-9A-Za-z]", 1)
    return F.concat(prefix, scramble(F.substring(value, F.length(prefix) + 1, F.length(value)), seed, salt, "postalCode", True))


def scramble(value: Column, seed: Column | str = SEED, salt: Column | str = "", kind: Column | str = "id", every: bool = False) -> Column:
    """Character by character within its class; the first digit stays zero or non-zero as it was, unless that
    zero is all there is. Letters and digits outside ASCII stay unless ``every`` is set, as all masking does. One md5 for 16 characters: the first 64 characters take theirs from the value, later
    ones from the first digest and their place, so that time is linear in the length."""
    lone = ~value.rlike("[\\p{L}\\p{Nd}].*[\\p{L}\\p{Nd}]")

    def ascii_swap(c: Column, r: Column, i: Column) -> Column:
        d = c.between("0", "9")
        return (
            F.when(d & (i == 0) & (c != "0"), F.char(49 + (F.ascii(c) - 49 + 1 + r % 8) % 9))
            .when(d & (i == 0) & ~lone, F.lit("0"))
            .when(d, F.char(48 + (F.ascii(c) - 48 + 1 + r % 9) % 10))
            .when(c.between("a", "z"), F.char(97 + (F.ascii(c) - 97 + 1 + r % 25) % 26))
            .when(c.between("A", "Z"), F.char(65 + (F.ascii(c) - 65 + 1 + r % 25) % 26))
            .otherwise(c)
        )

    def any_swap(c: Column, r: Column, i: Column) -> Column:
        """Letters and digits outside ASCII become ASCII ones of their case, those without case a Han sign."""
        sign = lambda page: F.decode(F.unhex(F.concat(F.lit(page), F.lpad(F.hex(r), 2, "0"))), "UTF-16BE")
        return (
            F.when(c <= "\x7f", ascii_swap(c, r, i)).when(c.rlike("\\p{Lu}"), F.char(65 + r % 26)).when(c.rlike("\\p{Ll}"), F.char(97 + r % 26))
            .when(c.rlike("\\p{Nd}"), F.char(49 + r % 9)).when(c.rlike("\\p{L}"), F.when(sign("4e") == c, sign("4f")).otherwise(sign("4e"))).otherwise(c)
        )

    def whole(draws: Column) -> Column:
        swap = any_swap if every else ascii_swap
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        return F.array_join(F.transform(chars, lambda c, i: swap(c, F.ascii(F.get(draws, i)), i)), "")

    def drawn(first: Column) -> Column:
        """A byte for each character, as a character of that code: far cheaper to read than two hex digits."""
        blocks = F.concat(first, *(F.when(F.length(value) > 16 * part, digest(seed, kind, value, salt, part)).otherwise("") for part in range(1, 4)))
        later = F.transform(F.sequence(F.lit(4), F.greatest(F.floor((F.length(value) - 1) / 16), F.lit(4)).cast("int")), lambda part: F.md5(F.concat_ws("\x01", first, part.cast("string")).cast("binary")))
        hexes = F.when(F.length(value) > 64, F.concat(blocks, F.array_join(later, ""))).otherwise(blocks)
        return F.split(F.decode(F.unhex(hexes), "ISO-8859-1"), "")

    # A lambda's body is evaluated for each element, so what it needs is bound to a variable first.
    bound = F.transform(F.transform(F.array(digest(seed, kind, value, salt, 0)), drawn), whole)
    return F.when(value == "", value).otherwise(F.element_at(bound, 1))


def whole_number(value: Column, seed: Column | str = SEED, kind: str = "id", top: int = (1 << 63) - 1) -> Column:
    """Another integer of as many digits, by a keyed bijection without fixed points, so that joins and distinct
    counts on masked keys are exact: an affine map modulo the count of such numbers. ``top`` is the largest
    number of the column's type; numbers of as many digits as it has are shifted among those it allows."""
    exact = F.abs(value.cast("decimal(20,0)"))
    size = F.length(exact.cast("string"))
    key = digest(seed, kind, size)
    step, shift = number(key, 1, 7) % 1_000_000, number(key, 9, 7) % 1_000_000
    least = F.when(value < 0, 1).otherwise(0)  # zero has no sign, so negative numbers keep away from it
    low = F.when(size == 1, least).otherwise(F.pow(F.lit(10.0), size - 1)).cast("long")
    count = F.when(size == 1, 10 - least).otherwise(9 * low)
    short = low + F.pmod((F.abs(value) - low) * (30 * step + 1) + 30 * shift + 7, count)
    wide = lambda c, digits=20: c.cast(f"decimal({digits},0)")
    far = F.try_to_number(F.rpad(F.lit("1"), size, "0"), F.lit("9" * 20)).cast("decimal(20,0)")
    affine = wide(far + F.pmod((exact - far) * wide(30 * step + 1, 9) + wide(30 * shift + 7, 9), far * 9))
    digits, first = len(str(top)), 10 ** (len(str(top)) - 1) if top > 9 else 0
    room = F.lit(top - first + 1).cast("decimal(20,0)") + F.when(value < 0, 1).otherwise(0)
    moved = wide(F.lit(first).cast("decimal(20,0)") + F.pmod(exact - first + F.pmod(wide(number(key, 1, 15)), room - 1) + 1, room))
    found = F.when(size == digits, moved).when(size <= 9, wide(short)).otherwise(affine)
    return F.when(value < 0, -found).otherwise(found).cast("long")


def whole_text(value: Column, seed: Column | str = SEED) -> Column:
    """The fake of a whole number's text: whole_number() where 64 bits hold it, digit_string() beyond; one id has one fake in
    every column, path and lane."""
    long = value.try_cast("long")
    wide = F.regexp_extract(value, r"^(-?)(\d+)$", 2)
    return F.when(long.isNotNull(), whole_number(long, seed).cast("string")).otherwise(F.concat(F.regexp_extract(value, r"^(-?)(\d+)$", 1), digit_string(wide, seed)))


def _added(digits: Column, key: Column) -> Column:
    """Each digit plus one drawn from ``key`` and its place, modulo ten."""
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat_ws("\x01", key, F.floor(i / 16).cast("string")).cast("binary")), 2 * (i % 16) + 1, 2), 16, 10).cast("int")
    places = F.filter(F.split(digits, ""), lambda c: c != "")
    return F.array_join(F.transform(places, lambda c, i: ((c.cast("int") + drawn(i)) % 10).cast("string")), "")


def digit_string(value: Column, seed: Column | str = SEED, kind: str = "id") -> Column:
    """Another string of as many decimal digits, any number of them, by a keyed bijection without fixed points: what
    follows the first digit goes through four Feistel rounds of two halves, and then the first digit moves on by one to all but one of its
    kind (1 to 9, or 0 alone), by what the rest has become. Numbers beyond 64 bits, which no integer type holds, take this way."""
    size = F.length(value)
    key = lambda part, other: digest(seed, F.lit(kind), F.concat_ws("\x01", size.cast("string"), F.lit(str(part)), other))
    rest = F.substring(value, 2, 1 << 20)
    half = F.floor((size - 1) / 2).cast("int")
    start = F.struct(rest.substr(F.lit(1), half).alias("left"), rest.substr(half + 1, size).alias("right"))

    def turn(part: int):
        if part % 2:
            return lambda pair: F.struct(_added(pair["left"], key(part, pair["right"])).alias("left"), pair["right"].alias("right"))
        return lambda pair: F.struct(pair["left"].alias("left"), _added(pair["right"], key(part, pair["left"])).alias("right"))

    bound = F.array(start)
    for part in range(4):
        bound = F.transform(bound, turn(part))

    def whole(pair: Column) -> Column:
        tail = F.concat(pair["left"], pair["right"])
        first = F.substring(value, 1, 1).cast("int")
        moved = F.when(first > 0, 1 + (first + number(key("first", tail)) % 8) % 9).otherwise(0)
        return F.concat(moved.cast("string"), tail)

    return F.when(value == "", value).otherwise(F.element_at(F.transform(bound, whole), 1))


def amount(value: Column, seed: Column | str = SEED, salt: Column | str = "") -> Column:
    """A price with two decimals, of the same sign and about the same size."""
    cents = F.floor(F.abs(value) * 100).cast("long")
    share = number(digest(seed, "priceAmount", cents, salt)) % 900 + 100
    made = (F.floor(cents * share / 1000).cast("long") + 1) / 100
    return F.when(value < 0, -made).otherwise(made)


def iso_date(value: Column, seed: Column | str = SEED, salt: Column | str = "", kind: Column | str = "isoDate") -> Column:
    """The date part moves by 1 to 700 days; what follows it stays."""
    days = (number(digest(seed, kind, value, salt)) % 700 + 1).cast("int")
    date = F.to_date(F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd")))
    return F.when(date.isNull(), scramble(value, seed, salt, every=True)).otherwise(F.concat(F.date_format(F.date_sub(date, days), "yyyy-MM-dd"), F.substring(value, 11, 1 << 20)))


def fake(kind: str, value: Column, seed: Column | str = SEED, salt: Column | str = "", parent: Column | str = "") -> Column:
    """The fake of a string value of a semantic type; ``parent`` is the parent path of paired codes."""
    key = digest(seed, kind, value, salt)
    h, g = number(key), number(key, 9)
    other = lambda options: in_case(other_pick(options, h, value), value)
    letters = value.rlike("^([A-Z]{3}|[a-z]{3})$")

    def code_or_name(pairs: tuple[tuple[str, str], ...], long: Column) -> Column:
        """A code for a code, of its width and case, a name for a name."""
        return F.when(F.length(value) == 2, other(tuple(c for _, c in pairs))).when(letters, long).otherwise(other(tuple(n for n, _ in pairs)))

    row = number(digest(seed, kind.removesuffix("Code").removesuffix("Message"), F.lit(""), parent))
    made = {
        "preserve": lambda: value,
        "auto": lambda: value,
        "null": lambda: F.lit(None).cast("string"),
        "redact": lambda: F.lit(REDACTED),
        "id": lambda: scramble(value, seed, salt, every=True),
        "sku": lambda: scramble(value, seed, salt, "sku", True),
        "phone": lambda: scramble(value, seed, salt, "phone", True),
        "postalCode": lambda: postal_code(value, seed, salt),
        "uuid": lambda: F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        "firstName": lambda: other_pick(FIRST_NAMES, h, value),
        "lastName": lambda: other_pick(LAST_NAMES, h, value),
        "fullName": lambda: F.concat_ws(" ", other_pick(FIRST_NAMES, h, F.substring_index(value, " ", 1)), pick(LAST_NAMES, g)),
        "email": lambda: F.concat(F.lower(pick(FIRST_NAMES, h)), F.lit("."), F.substring(key, 9, 8), F.lit("@example.com")),
        "company": lambda: other_pick(COMPANIES, h, value),
        "productName": lambda: F.concat_ws(" ", F.initcap(pick(WORDS, h)), F.initcap(pick(WORDS, g))),
        "street": lambda: in_case(F.concat_ws(" ", (h % 899 + 100).cast("string"), pick(STREETS, g)), value),
        "streetSecondary": lambda: in_case(F.concat_ws(" ", F.lit("Unit"), (h % 899 + 100).cast("string")), value),
        "city": lambda: other(CITIES),
        "state": lambda: code_or_name(STATES, scramble(value, seed, salt, kind)),
        "stateOrProvince": lambda: code_or_name(STATES, scramble(value, seed, salt, kind)),
        "country": lambda: code_or_name(COUNTRIES, other(LONG_CODES)),
        "countryCode": lambda: F.when(letters, other(LONG_CODES)).otherwise(other(tuple(c for _, c in COUNTRIES))),
        "currency": lambda: F.when(value == F.lower(value), F.lower(other_pick(CURRENCIES, h, value))).otherwise(other_pick(CURRENCIES, h, value)),
        "ipv4": lambda: F.concat_ws(".", pick(("192.0.2", "198.51.100", "203.0.113"), h), (g % 254 + 1).cast("string")),
        "isoDate": lambda: iso_date(value, seed, salt),
        "birthDate": lambda: iso_date(value, seed, salt, "birthDate"),
        "url": lambda: F.concat(F.lit("https://example.com/"), F.substring(key, 1, 12)),
        "shortText": lambda: F.concat_ws(" ", *(pick(WORDS, number(key, 1 + 4 * k, 4)) for k in range(3))),
        "longText": lambda: F.concat(F.concat_ws(" ", *(pick(WORDS, number(key, 1 + 3 * k, 3)) for k in range(10))), F.lit(".")),
        "cvvCode": lambda: pick(tuple(c for c, _ in CHECK_RESULTS), row),
        "cvvMessage": lambda: pick(tuple(m for _, m in CHECK_RESULTS), row),
        "avsCode": lambda: pick(tuple(c for c, _ in CHECK_RESULTS), row),
        "avsMessage": lambda: pick(tuple(m for _, m in CHECK_RESULTS), row),
    }
    if kind not in made:
        raise ValueError(f"unknown type {kind}")
    return F.when(value.isNull() | (value == ""), value).otherwise(made[kind]()) if kind not in ("null", "redact") else made[kind]()


TYPES = (
    "preserve", "auto", "null", "redact", "id", "sku", "phone", "postalCode", "uuid", "firstName", "lastName", "fullName", "email", "company", "productName", "street",
    "streetSecondary", "city", "state", "stateOrProvince", "country", "countryCode", "currency", "ipv4", "isoDate", "birthDate", "url", "shortText", "longText",
    "cvvCode", "cvvMessage", "avsCode", "avsMessage", "priceAmount", "unixTimestamp", "boolean", "nestedJson", "custom",
)
