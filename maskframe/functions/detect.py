"""Generic detection: the semantic type of a leaf from its path and value, first match wins.

The path part depends on the path alone and is meant to be evaluated once a distinct path; the value part
sees string leaves that no path rule decided.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.paths import snake, tail

# ---- Fixed values: keys, placeholders and shapes that decide the type of a field ----
# Keys are listed one by one and not as patterns, so that one lookup in a map finds a value's type.
PLACEHOLDERS = ("", "n/a", "na", "none", "null", "nil", "undefined", "unknown", "-", "—")
HANDLE_KEYS = ("username", "user_name", "screenname", "screen_name", "displayname", "display_name", "handle", "login", "nick", "nickname", "prefixedname", "prefixed_name")
ID_KEYS = (
    "id", "customer_id", "order_id", "user_id", "account_id", "product_id", "variant_id", "cart_id", "subscription_id", "invoice_id", "charge_id", "transaction_id", "payment_id",
    "external_id", "merchant_id", "tax_id", "address_id", "company_id", "store_id", "channel_id", "gateway_transaction_id", "payment_provider_id", "reference_transaction_id",
    "payment_instrument_token", "uid", "guid", "gid", "jwt", "apikey", "api_key",
)
ID_ENDINGS = ("_id", "_ids", "_uid", "_token", "_secret", "_apikey", "_api_key")
KEYS = {
    "email": ("email", "e_mail", "email_address"),
    "firstName": ("first_name", "firstname", "given_name"),
    "lastName": ("last_name", "lastname", "surname", "family_name"),
    "fullName": ("full_name", "fullname", "customer_name"),
    "phone": ("phone", "phone_number", "telephone", "mobile", "cell"),
    "company": ("company", "company_name", "organization", "organisation"),
    "street": ("street", "street1", "street_1", "address", "address1", "address_1", "line1", "street_address"),
    "streetSecondary": ("street2", "street_2", "address2", "address_2", "line2"),
    "city": ("city", "town", "locality"),
    "stateOrProvince": ("state", "province", "region", "state_or_province"),
    "postalCode": ("zip", "zipcode", "zip_code", "postal_code", "postcode"),
    "country": ("country", "country_name"),
    "countryCode": ("country_code", "country_iso2", "iso_country"),
    "birthDate": ("dob", "date_of_birth", "birthdate", "birth_date", "birthday"),
    "ipv4": ("ip", "ip_address", "remote_addr"),
    "sku": ("sku", "item_sku", "product_sku"),
    "currency": ("currency", "currency_code", "default_currency_code", "store_default_currency_code"),
    "shortText": ("note", "notes", "comment", "comments"),
}
PAIRED = {"cvv_result.code": "cvvCode", "cvv_result.message": "cvvMessage", "avs_result.code": "avsCode", "avs_result.message": "avsMessage"}
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
JWT = r"^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
LONG_HEX = r"^[0-9a-fA-F]{32,}$"
IPV4 = r"^(?:\d{1,3}\.){3}\d{1,3}$"
URL = r"^[hH][tT][tT][pP][sS]?://[^\s]+$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
CARD = r"^\d{13,19}$"
PHONE = r"^\+?[\d\s\-().]{7,}$"
PERSON = r"^\p{Lu}[\p{L}'.-]*(?: \p{Lu}[\p{L}'.-]*){1,3}$"
LABEL = "^[a-z]+(?:[-_][a-z]+)*$"
PHONE_MARK = r"[+\s\-().]"
HANDLE = "[_0-9]"
# ---- End of fixed values ----


#: The type of each listed key; of two types that list a key the first counts.
_TYPE_OF = {key: kind for kind, keys in reversed([("id", ID_KEYS), *KEYS.items()]) for key in keys}
_TYPE_OF_HANDLES = {key: "handle" for key in HANDLE_KEYS}


def _listed(types: Mapping[str, str], name: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in types.items() for x in pair))[name]


def _by_key(name: Column) -> Column:
    """A name stands here twice and not once a key, as each use of it is worked out again."""
    return F.coalesce(_listed(_TYPE_OF, name), F.when(name.rlike(f"(?:{'|'.join(ID_ENDINGS)})$"), "id"))


def path_type(path: Column) -> Column:
    """The type that a path asks for: a paired code, ``handle``, a key's type, ``name``, or null."""
    last = tail(path)
    plain, snaked, low = F.lower(last), F.lower(snake(last)), F.lower(path)
    chain = None
    for ending, kind in PAIRED.items():
        chain = F.when(F.endswith(low, F.lit(ending)), kind) if chain is None else chain.when(F.endswith(low, F.lit(ending)), kind)
    handle = [_listed(_TYPE_OF_HANDLES, name) for name in (plain, snaked)]
    return F.coalesce(chain, *handle, _by_key(plain), _by_key(snaked), F.when(plain == "name", "name"))


def id_like_key_value(value: Column, is_string: Column) -> Column:
    """Whether a value under an id key is an identifier and not a label or a small number."""
    label = value.rlike(LABEL)
    return F.when(is_string, (F.length(value) >= 4) & ~label).otherwise(F.coalesce(value.try_cast("double") >= 1000, F.lit(False)))


def literal_path_type(path: str) -> str | None:
    """path_type() of a path that is known when the plan is made, or once a path and process."""
    for ending, kind in PAIRED.items():
        if path.lower().endswith(ending):
            return kind
    found = re.search(r"([A-Za-z0-9_]+)(?:\[[0-9]*\])*(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)", path)
    last = found[1] if found else ""
    names = (last.lower(), re.sub("([a-z0-9])([A-Z])", r"\1_\2", last).lower())
    if any(name in HANDLE_KEYS for name in names):
        return "handle"
    for name in names:
        if name in ID_KEYS or name.endswith(ID_ENDINGS):
            return "id"
        for kind, keys in KEYS.items():
            if name in keys:
                return kind
    return "name" if names[0] == "name" else None


def value_tests(value: Column) -> list[tuple[Column, str]]:
    """(condition, type) in order; the first that holds is the type of a whole string."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    card = value.rlike(CARD) & F.call_function("luhn_check", F.when(value.rlike(CARD), value))
    phone = value.rlike(PHONE) & value.rlike(PHONE_MARK) & digits.between(7, 15)
    shapes = [(EMAIL, "email"), (JWT, "id"), (UUID, "uuid"), (LONG_HEX, "id"), (IPV4, "ipv4"), (URL, "url"), (ISO_DATE, "isoDate")]
    return [*((value.rlike(pattern), kind) for pattern, kind in shapes), (card, "redact"), (phone, "phone")]


def value_type(value: Column) -> Column:
    """The type that a whole string shows, or ``preserve``."""
    chain = None
    for test, kind in value_tests(value):
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.otherwise("preserve")


def name_tests(value: Column) -> list[tuple[Column, str]]:
    """Tests of the value under a bare ``name``: a person, or a handle."""
    trimmed = F.trim(value)
    return [(trimmed.rlike(PERSON), "fullName"), ((F.length(trimmed) >= 5) & ~trimmed.rlike(r"\s") & trimmed.rlike(HANDLE), "id")]


def is_placeholder(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*PLACEHOLDERS)


def detect(by_path: Column, value: Column, kind: Column, shown: Column | None = None) -> Column:
    """The type of a leaf. ``by_path`` is path_type() of its path, ``kind`` its JSON kind; ``shown`` is value_type(value) where a
    caller has it as a column. Tests of the value stand here once, as each use of them is worked out again."""
    text = kind == "string"
    (person, full), (handle, other) = name_tests(value)
    decided = (
        F.when(text & is_placeholder(value), "preserve")
        .when(by_path == "handle", "id")
        .when((by_path == "id") & ~id_like_key_value(value, text), "preserve")
        .when(by_path == "name", F.when(text & person, full).when(text & handle, other))
        .otherwise(by_path)
    )
    return F.coalesce(decided, F.when(text, value_type(value) if shown is None else shown), F.lit("preserve"))


def id_like(value: Column, kind: Column) -> Column:
    """The type given to a value that a user opts in without a rule."""
    return (
        F.when(kind == "boolean", "boolean").when(kind == "number", "id").when(value.rlike("^[0-9]+$"), "id").when(value.rlike("^[0-9a-fA-F-]{36}$"), "uuid")
        .when(value.rlike("^[A-Za-z0-9_-]{6,}$"), "id").otherwise("shortText")
    )
