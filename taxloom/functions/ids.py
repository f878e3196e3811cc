"""Stable identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:taxloom:chunks")


def stable_id(*parts: Column) -> Column:
    """uuid5 of the colon-joined parts, equal to Python's ``uuid.uuid5`` on UTF-8 text."""
    name = F.concat_ws(":", *parts)
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def table_ref(document_type: Column, index: Column) -> Column:
    slug = F.replace(F.lower(document_type), F.lit(" "), F.lit("_"))
    return F.concat(slug, F.lit("_table_"), index.cast("string"))
