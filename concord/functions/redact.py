"""Redaction and scans of sensitive or garbled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import canonical_json

#: Parts of a key's name whose values are hidden. Those with "token" have an exception, see STATISTIC.
SENSITIVE = ("password", "passwd", "secret", "token", "cookie", "signature", "private_key", "access_key", "app_secret", "authorization", "session")
#: More of our own.
ALSO_SENSITIVE = ("pwd", "api_key", "passphrase", "credential")
#: Words that mark a key with "token" as a statistic, which stays.
STATISTIC = ("count", "rows", "shops", "total", "scope", "summary", "credential", "target", "top", "unverified", "expired")
HIDDEN = "<redacted>"

#: Named patterns of sensitive text.
SECRET_PATTERNS = {
    "Bearer token": r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{20,}",
    "Authorization header": r"(?i)authorization\s*[:=]\s*['\"]?[^'\"\s<]{12,}",
    "Cookie value": r"(?i)cookie\s*[:=]\s*['\"]?[^'\"<]{20,}",
    "Secret field": r"(?i)(token|password|passwd|pwd|secret|api_key|appsecret)\s*[:=]\s*['\"]?[^'\"\s<]{8,}",
    "Connection string": r"(?i)(jdbc|mysql|postgresql|mongodb|redis)://[^'\"<\s]+",
}

#: Marks of text that was garbled on its way.
GARBLED_PATTERNS = {"question marks": r"\?{4,}", "replacement character": "�", "unicode escape": r"\\u[0-9a-fA-F]{4}"}


#: A statistic word that stands as a word of its own in a key, in snake or camel case.
_WHOLE = "(?:(?<![A-Za-z])(?i:" + "|".join(STATISTIC) + ")|(?<=[a-z])(?:" + "|".join(w.capitalize() for w in STATISTIC) + "))(?![a-z])"


#: What always hides, in any case and with any or no separators between its words, and the word that hides with an exception.
_ALWAYS = "(?i:" + "|".join(w.replace("_", "[-_. ]*") for w in (*SENSITIVE, *ALSO_SENSITIVE) if w not in ("token", "credential")) + "|(?<!token[-_. ]{0,3})credential)"
_TOKEN = "(?i:token)"


def is_sensitive_key(key: Column) -> Column:
    """Keys that name a secret, in snake, kebab or camel case. Keys of tokens are spared where a whole word of theirs is a statistic, as in token_count; no others are."""
    return key.rlike(_ALWAYS) | (key.rlike(_TOKEN) & ~key.rlike(_WHOLE))


#: An assignment of eight or more characters to a name that ends in a sensitive word.
ASSIGNED = r"""(?i)((?:token|password|passwd|pwd|secret|signature|passphrase|credential|api[-_. ]?key|access[-_. ]?key|private[-_. ]?key)["']?\s*[:=]\s*["']?)[A-Za-z0-9+/_.=-]{8,}"""


def redact_text(c: Column) -> Column:
    """Bearer tokens, the secrets of query strings, and of assignments, also in JSON or quoted, to names that end in a sensitive word."""
    # The first two patterns.
    text = F.regexp_replace(c, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{12,}", f"$1{HIDDEN}")
    text = F.regexp_replace(text, r"(?i)([?&](?:token|password|secret|access_token|refresh_token)=)[^&\s]+", f"$1{HIDDEN}")
    return F.regexp_replace(text, ASSIGNED, f"$1{HIDDEN}")


def redact_map(c: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), F.when(is_sensitive_key(e["key"]), F.lit(HIDDEN)).otherwise(redact_text(e["value"])).alias("value"))))


def _json_value(depth: int) -> str:
    """A pattern for JSON values without blanks, nested up to ``depth``."""
    text = r'"(?:[^"\\]|\\.)*+"'
    value = text + r"|[-0-9.eE+]++|true|false|null"
    for _ in range(depth):
        value = rf"{text}|[-0-9.eE+]++|true|false|null|\[(?:(?:{value})(?:,(?:{value}))*+)?\]|\{{(?:{text}:(?:{value})(?:,{text}:(?:{value}))*+)?\}}"
    return value


def redact_json(c: Column, depth: int = 3) -> Column:
    """JSON text with the values of sensitive keys hidden at any depth, lists and objects as a whole, and text values cleaned.

    Where the value of a sensitive key is nested deeper than ``depth`` the whole document is hidden.
    """
    name = rf'"((?:(?=[^"]*{_ALWAYS})|(?=[^"]*{_TOKEN})(?![^"]*{_WHOLE}))[^"]*)":'
    hidden = F.regexp_replace(canonical_json(c), f"{name}(?:{_json_value(depth)})", f'"$1":"{HIDDEN}"')
    return F.when(hidden.rlike(rf"{name}[\[{{]"), F.lit(f'"{HIDDEN}"')).otherwise(redact_text(hidden))


def hash_sample(*cols: Column) -> Column:
    """A value that may be compared but not read."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("<NULL>")) for c in cols]), 256)


def _scan(df: DataFrame, text_col: str, patterns: dict[str, str], keep) -> DataFrame:
    names = F.filter(F.array(*[F.when(F.col(text_col).rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(names).alias("finding"))


def scan_secrets(df: DataFrame, text_col: str, keep=()) -> DataFrame:
    """One row for each row and named pattern that its text matches."""
    return _scan(df, text_col, SECRET_PATTERNS, keep)


def scan_garbled(df: DataFrame, text_col: str, keep=()) -> DataFrame:
    return _scan(df, text_col, GARBLED_PATTERNS, keep)
