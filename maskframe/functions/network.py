"""Rules for names and values in network logs: headers, cookies, parameters, URLs, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.detect import UUID
from maskframe.functions.fakes import scramble
from maskframe.functions.hashing import SEED
from maskframe.functions.paths import snake

# ---- Fixed values: names that carry credentials ----
SECRET_HEADERS = (
    "authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key", "apikey", "x-auth-token", "x-access-token", "x-csrf-token", "x-xsrf-token",
    "x-session-token", "x-amz-security-token", "x-goog-api-key", "x-functions-key", "x-shopify-access-token",
)
SECRET_HEADER = "(authorization|auth[_-]?token|access[_-]?token|secret|cookie|session|csrf|xsrf|password|credential|api[_-]?key|bearer)"
SECRET_PARAM = (
    "(^|[_-])(token|key|secret|password|passwd|pwd|signature|sig|auth|session|sid|apikey|otp|nonce|credential|client[_-]?secret|access[_-]?token|refresh[_-]?token|id[_-]?token)([_-]|$)"
)
SENSITIVE_COOKIE = "(session|sess|token|auth|csrf|xsrf|secret|credential|sid|jwt|bearer|_octo|telemetry|device|account|login|user|^id$)"
PRIVATE_IP = r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|::1$|fe80:|f[cd][0-9a-f]{2}:)"
LINK_HEADERS = ("location", "referer", "origin", "content-location")
# ---- End of fixed values ----


def is_secret_header(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return low.isin(*SECRET_HEADERS) | low.rlike(SECRET_HEADER)


def is_secret_param(name: Column) -> Column:
    plain = F.trim(name)
    return (F.lower(plain) == "code") | F.lower(plain).rlike(SECRET_PARAM) | F.lower(snake(plain)).rlike(SECRET_PARAM)


def looks_like_token(value: Column) -> Column:
    """A UUID, or a run of 16 letters and digits that has both; never a link."""
    v = F.trim(value)
    runs = F.regexp_extract_all(v, F.lit("[A-Za-z0-9]{16,}"), 0)
    mixed = F.exists(runs, lambda r: r.rlike("[A-Za-z]") & r.rlike("[0-9]"))
    return (F.length(v) >= 16) & ~v.rlike("^[hH][tT][tT][pP][sS]?://") & (v.rlike(UUID) | mixed)


def is_sensitive_cookie(name: Column, value: Column) -> Column:
    return F.lower(F.trim(name)).rlike(SENSITIVE_COOKIE) | looks_like_token(value)


def is_sensitive_param(name: Column, value: Column) -> Column:
    return is_secret_param(name) | looks_like_token(value)


def is_private_ip(ip: Column) -> Column:
    return F.lower(F.trim(ip)).rlike(PRIVATE_IP)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _pairs(url: Column) -> Column:
    return F.filter(F.split(_query(url), "&"), lambda p: p != "")


def userinfo(url: Column) -> Column:
    """What stands before ``@`` in the authority; parts by pattern, so odd URLs are judged too."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)@", 1)


def url_has_secrets(url: Column) -> Column:
    return (userinfo(url) != "") | F.exists(_pairs(url), lambda p: is_secret_param(F.substring_index(p, "=", 1)))


def redact_url(url: Column, seed: Column | str = SEED) -> Column:
    """Fake user, password and secret query values; everything else stays in place."""

    def pair(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        value = F.substring(p, F.length(name) + 2, F.length(p))
        return F.when(is_secret_param(name) & (value != ""), F.concat(name, F.lit("="), scramble(value, seed, every=True))).otherwise(p)

    user = userinfo(url)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    rest = F.substring(url, F.length(scheme) + 1 + F.when(user != "", F.length(user) + 1).otherwise(0), F.length(url))
    head, query, hash_ = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1), F.regexp_extract(rest, "(#.*)$", 1)
    masked_user = F.when(user != "", F.concat(scramble(user, seed, every=True), F.lit("@"))).otherwise("")
    masked_query = F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.transform(F.split(F.substring(query, 2, 1 << 30), "&"), pair), "&")))
    return F.when(url_has_secrets(url), F.concat(scheme, masked_user, head, masked_query, hash_)).otherwise(url)


def short_url(url: Column) -> Column:
    """Host and path, or the first 80 characters of what is no absolute URL."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]+[^?#]*)", 1)
    return F.when(found != "", found).otherwise(F.substring(url, 1, 80))


def default_redact(section: Column, name: Column, value: Column) -> Column:
    """Whether a value is redacted unless someone says otherwise."""
    return (
        F.when(F.coalesce(value, F.lit("")) == "", False)
        .when((section == "header") & F.lower(name).isin(*LINK_HEADERS), url_has_secrets(value))
        .when(section == "header", is_secret_header(name))
        .when(section == "cookie", is_sensitive_cookie(name, value))
        .when(section == "param", is_sensitive_param(name, value))
        .when(section == "ip", ~is_private_ip(value))
        .otherwise(False)
    )


def fake_auth(value: Column, seed: Column | str = SEED) -> Column:
    """Keeps the scheme word and the gap after it; fakes the credential."""
    word = F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9_-]*\s+)\S", 1)
    return F.concat(word, scramble(F.substring(value, F.length(word) + 1, F.length(value)), seed, every=True))


def target_key(section: Column, name: Column, value: Column) -> Column:
    """One key for each section, name (headers: any case) and value; 128 bits."""
    return F.md5(F.concat_ws("\x01", section, F.when(section == "header", F.lower(name)).otherwise(name), value).cast("binary"))


def body_is_maskable(mime: Column, encoding: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return (F.coalesce(F.lower(encoding), F.lit("")) != "base64") & ~kind.rlike("^(image|audio|video|font)/") & kind.rlike("json|xml|x-www-form-urlencoded|csv")


def looks_encoded(text: Column) -> Column:
    """Packed bytes, control bytes near the start, or one long base64 run."""
    head = F.substring(text, 1, 64)
    return text.rlike(r"^(\x1f|\x78[\x01\x5e\x9c\xda])") | head.rlike(r"[\x00-\x08\x0e-\x1f]") | ((F.length(text) > 64) & text.rlike(r"^[A-Za-z0-9+/\s]+={0,2}\s*$"))
