"""Deterministic identifiers: RFC 4122 version-5 UUIDs as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.config import DECISION_ID_NAMESPACE, EVENT_ID_NAMESPACE, REJECT_ID_NAMESPACE


def uuid5(namespace: str, name: Column) -> Column:
    """`uuid.uuid5(namespace, name)` without leaving the JVM.

    SHA-1 of namespace bytes + name; 16 bytes kept; version nibble 5; variant bits 10.
    """
    salt = F.unhex(F.lit(uuid.UUID(namespace).hex))
    digest = F.sha1(F.concat(salt, F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def iso_utc(ts: Column) -> Column:
    """ISO text of a UTC instant; the fraction is left out when it is zero."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))


def event_id(customer: Column, session: Column, ts: Column, kind: Column, seq: Column) -> Column:
    name = F.concat_ws("|", customer, session, iso_utc(ts), kind, seq.cast("string"))
    return uuid5(EVENT_ID_NAMESPACE, name)


def reject_id(raw_json: Column, reason: Column, stage: Column) -> Column:
    return uuid5(REJECT_ID_NAMESPACE, F.concat_ws("|", raw_json, reason, stage))


def decision_id(customer: Column, as_of: Column, policy: Column, config_hash: Column,
                model_versions: Column) -> Column:
    name = F.concat_ws("|", customer, iso_utc(as_of), policy, config_hash, model_versions)
    return uuid5(DECISION_ID_NAMESPACE, name)


def canonical_json(**fields: Column) -> Column:
    """JSON object text with sorted keys and no spaces."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})
