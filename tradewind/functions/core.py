"""Column functions that the plans share; all stay in generated JVM code."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n, d) -> Column:
    """n / d as double; null where d is nought or either is null."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (n, d))
    return F.try_divide(n.cast("double"), F.nullif(d.cast("double"), F.lit(0.0)))


def money(c) -> Column:
    """An exact sum of amounts, as double: sums of decimals don't depend on the order of rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def clean(c: str, case: str = "") -> Column:
    """Trimmed, blank is null; case: upper or lower."""
    x = F.nullif(F.trim(F.col(c)), F.lit(""))
    return getattr(F, case)(x) if case else x


def errors(*checks: tuple[Column, str]) -> Column:
    """All codes whose condition holds, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in checks]))


def distinct_where(cond: Column, c: str) -> Column:
    return F.count_distinct(F.when(cond, F.col(c)))


def sample_band(n: Column) -> Column:
    return F.when(n < 30, "LOW").when(n < 100, "MEDIUM").otherwise("HIGH")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) of a text column."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a text column under a fixed key."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def phone(c: str, country: str = "212") -> Column:
    """Digits of a phone number with the country's prefix; null below nine digits."""
    digits = F.regexp_replace(F.regexp_replace(F.col(c), r"[^0-9]", ""), r"^00", "")
    full = F.when(digits.startswith(country), digits).when(digits.startswith("0"), F.concat(F.lit(country), F.expr(f"substring(regexp_replace(regexp_replace({c}, '[^0-9]', ''), '^00', ''), 2)"))).otherwise(digits)
    return F.when(F.length(full) >= 9, full)


def utm(url: str, key: str) -> Column:
    """A query parameter of a URL, decoded (what isn't a valid escape stays as it is) and cut at 255 characters, null if blank."""
    raw = F.regexp_replace(F.regexp_extract(F.col(url), rf"[?&]{key}=([^&#]*)", 1), r"\+", " ")
    return F.nullif(F.left(F.coalesce(F.try_url_decode(raw), raw), F.lit(255)), F.lit(""))


#: Campaign parameters, and the characters that may stand around a value in a run of them.
UTM_NAMES = ("source", "id", "medium", "campaign", "content", "term")
_AROUND = " \\t\\r\\n,;&\"'}"


def utm_texts(c: str) -> dict[str, Column]:
    """{utm_source: ..} of a text column that holds a JSON object, or a run of key[:=]value with or without anything between.

    A run is cut at its known keys (utm_ before them or not, in any case), the last of equal keys
    holds, values are decoded. In JSON, blanks in keys count as underscores and utm_x comes before
    x. Blank values are null, longer ones are cut at 255 characters.
    """
    text = F.trim(F.col(c))
    entries = F.map_entries(F.from_json(text, "map<string, string>"))
    named = F.transform(entries, lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), " ", "_").alias("key"), e["value"].alias("value")))
    json = F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), named)
    marked = F.regexp_replace(text, rf"(?i)(?:utm[_ ]?)?({'|'.join(UTM_NAMES)})\s*[:=]\s*[\"']?", "\u0001$1\u0002")
    runs = F.transform(F.filter(F.split(marked, "\u0001"), lambda x: x.contains("\u0002")), lambda x: F.struct(F.concat(F.lit("utm_"), F.lower(F.split_part(x, F.lit("\u0002"), F.lit(1)))).alias("key"), F.split_part(x, F.lit("\u0002"), F.lit(2)).alias("value")))
    last = lambda found, key: F.try_element_at(F.filter(found, lambda e: e["key"] == key), F.lit(-1))["value"]
    bare = lambda v: F.regexp_replace(v, f"^[{_AROUND}]+|[{_AROUND}]+$", "")
    decoded = lambda v: F.coalesce(F.try_url_decode(v), F.regexp_replace(v, r"\+", " "))
    tidy = lambda v: F.nullif(F.left(F.trim(v), F.lit(255)), F.lit(""))
    out = {}
    for n in UTM_NAMES:
        of_json = F.coalesce(last(json, f"utm_{n}"), last(json, n))
        out[f"utm_{n}"] = tidy(F.when(json.isNotNull(), of_json).otherwise(decoded(bare(last(runs, f"utm_{n}")))))
    return out
