"""Canonical JSON and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def fingerprint(**fields: Column) -> Column:
    return content_hash(canonical_json(**fields))
