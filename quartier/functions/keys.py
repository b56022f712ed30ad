"""Join keys, hashes and deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_key(key: Column, width: int = 10, strip_fraction: bool = False) -> Column:
    """The last ``width`` digits of a key, padded with zeros in front; null without any digit but 0.

    ``strip_fraction`` first drops a decimal fraction of zeros, as float-formatted keys have it.
    """
    text = key.cast("string")
    if strip_fraction:
        text = F.regexp_replace(text, r"\.0*\s*$", "")
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(digits.rlike("[1-9]"), F.lpad(F.right(digits, F.lit(width)), width, "0"))


def resolve_key(key: Column, billing: Column) -> Column:
    """The billing key where there is one that isn't all zeros; null if the key itself is null."""
    usable = billing.isNotNull() & billing.rlike("[1-9]")
    return F.when(key.isNull(), F.lit(None)).when(usable, billing).otherwise(key)


def encode_prefix(key: Column, codes: dict[str, int], n: int = 2) -> Column:
    """The integer code of the key's first n characters, 0 for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring(key, 1, n)), F.lit(0))


def version_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]))


def uuid5(namespace: uuid.UUID, name: Column, hyphens: bool = True) -> Column:
    """The version-5 UUID of a name, as RFC 4122 defines it."""
    digest = F.sha1(F.concat(F.lit(namespace.bytes), name.cast("binary")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), nibble % 4 + 1)
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
             F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-" if hyphens else "", *parts)
