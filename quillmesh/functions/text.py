"""Column functions on text, vectors and JSON that Spark has no single built-in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def is_blank(text: Column) -> Column:
    """Null or nothing but white space."""
    return text.isNull() | ~text.rlike(r"\S")


def strip_trailing(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def strip_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def contains_any(text: Column, keywords: Column) -> Column:
    """True if any keyword is a substring of the text, case aside; false for null or blank text or null keywords.

    An empty keyword is in every text that isn't blank. Null keywords in the list match nothing.
    """
    lower = F.lower(text)
    hit = F.exists(keywords, lambda k: F.coalesce(F.contains(lower, F.lower(k)), F.lit(False)))
    return F.coalesce(~is_blank(text) & hit, F.lit(False))


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash over UTF-16 code units, base 31, as a signed int; null for null."""
    step = lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32))
    # A character beyond the basic plane is two units.
    high = lambda c: F.shiftright(c - 0x10000, 10) + 0xD800
    low = lambda c: (c - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    wide = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, c: F.when(c > 0xFFFF, step(step(h, high(c)), low(c))).otherwise(step(h, c)))
    return F.when(wide >= (1 << 31), wide - (1 << 32)).otherwise(wide).cast("int")


def hash_embedding(text: Column, dims: int) -> Column:
    """Array of ``dims`` floats: counts of the words of the text in lower case, by their hash; null for null. For tests
    and as a stand-in for a model."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    at = F.transform(words, lambda w: F.pmod(string_hash(w), F.lit(dims)))
    return F.when(text.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("float")))


def as_double(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the cosine; null if a vector is zero or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1.0 - dot(a, b) / norm)


def l2_distance(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


DISTANCES = {"cosine": cosine_distance, "l2": l2_distance, "inner_product": negative_inner_product}
