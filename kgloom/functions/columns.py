"""Column helpers; each is built of Spark's own functions, so plans stay inside generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import NODE_TYPE_ALIASES, NODE_TYPES, RELATIONSHIP_ALIASES, RELATIONSHIP_TYPES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Column | str) -> Column:
    """The string, or null where it is empty."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    """First string that is neither null nor empty."""
    return F.coalesce(*map(filled, cs))


def number(c: Column | str) -> Column:
    """Leading decimal number of a string, else null; numbers stay."""
    return F.regexp_extract(col(c).cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def nonzero(c: Column | str, default: float) -> Column:
    """The number, or the default where it is missing or zero."""
    return F.coalesce(F.nullif(number(c), F.lit(0.0)), F.lit(float(default)))


def leading_int(c: Column | str) -> Column:
    return F.regexp_extract(col(c).cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int")


def round_half_up(c: Column | str) -> Column:
    """Halves go towards positive infinity."""
    return F.floor(col(c) + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def node_size(c: Column | str) -> Column:
    """Whole number from 1 to 100; 20 where missing or zero."""
    return clamp(round_half_up(nonzero(c, 20)), 1, 100).cast("double")


def edge_weight(c: Column | str) -> Column:
    """0.1 to 10; 1 where missing or zero."""
    return clamp(nonzero(c, 1), 0.1, 10)


def slug(c: Column | str) -> Column:
    """Lower case, letters and digits only, spaces as underscores, 50 characters."""
    kept = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s]", "")
    return F.substring(F.regexp_replace(kept, r"\s+", "_"), 1, 50)


def alnum(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]", "")


def store_key(c: Column | str) -> Column:
    """Key of the store: other characters become underscores, so does a first one that is no letter; 254 characters."""
    key = F.regexp_replace(F.regexp_replace(filled(c), r"[^a-zA-Z0-9_-]", "_"), r"^[^a-zA-Z_]", "_")
    return F.substring(key, 1, 254)


def prettified(c: Column | str) -> Column:
    """Underscores as spaces, the first character of each word in upper case."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(col(c), "_+", " "), r"\s+", " "))
    return F.array_join(F.transform(F.split(spaced, r"(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def truncated(c: Column | str, n: int = 150) -> Column:
    return F.when(F.char_length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def header(c: Column | str) -> Column:
    """Normalised CSV header."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "['\"]", ""), r"\s+", "_")


def header_name(h: str) -> str:
    return re.sub(r"\s+", "_", re.sub("['\"]", "", h.strip().lower()))


def _alias(c: Column, names: dict[str, str], allowed: list[str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    found = F.coalesce(F.try_element_at(table, c), c)
    return F.when(found.isin(allowed), found).otherwise(F.lit(default))


def node_type(c: Column | str) -> Column:
    return _alias(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), NODE_TYPE_ALIASES, NODE_TYPES, "concept")


def relationship_type(c: Column | str) -> Column:
    return _alias(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))), RELATIONSHIP_ALIASES, RELATIONSHIP_TYPES, "RELATED_TO")


def split_names(c: Column | str, pattern: str = "[,;]") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def valid_year(c: Column | str, last: int) -> Column:
    """Leading whole number from 1900 to last, else null."""
    y = leading_int(c)
    return F.when(y.between(1900, last), y)


def quoted(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def occurrences(c: Column | str, word: Column | str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    w = F.lit(word) if isinstance(word, str) else word
    return F.when(F.octet_length(w) > 0, ((F.octet_length(col(c)) - F.octet_length(F.replace(col(c), w, F.lit("")))) / F.octet_length(w)).cast("int")).otherwise(0)


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def tokens(c: Column | str, pattern: str = r"\s+") -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), pattern), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def word_match(c: Column, *words: str) -> Column:
    """Whether one of the words stands in text of ASCII word characters, hyphens and spaces."""
    return c.rlike(rf"(?:^|[^A-Za-z0-9_])(?:{'|'.join(map(quoted, words))})(?:$|[^A-Za-z0-9_])")
