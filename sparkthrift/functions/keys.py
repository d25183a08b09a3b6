"""Hashed identities: cache keys, tenants, graph nodes, prefix digests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_VERSION = "v1"
ANONYMOUS = "anon"
CREDENTIAL_HEADERS = ("x-api-key", "authorization")


def _lower_escapes(json: Column) -> Column:
    r"""Control characters as \u001f, not \u001F (only escapes: an even run of backslashes stays)."""
    out = json
    for high in "01":
        for low in "ABCDEF":
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{high}{low}", rf"$1\\u00{high}{low.lower()}")
    return out


def cache_key(dialect: Column, model: Column, system: Column, messages: Column, tools: Column, salt: str = "") -> Column:
    """Key over the canonical request; ``messages`` is array<array<string>> of (role, text)."""
    payload = F.struct(dialect.alias("dialect"), messages.alias("messages"), model.alias("model"), system.alias("system"), tools.alias("tools"), F.lit(KEY_VERSION).alias("v"))
    blob = _lower_escapes(F.to_json(payload, {"ignoreNullFields": "false"}))
    if salt:
        blob = F.concat(F.lit(salt + "\0"), blob)
    return F.concat(F.lit(f"{KEY_VERSION}:"), F.sha2(blob, 256))


def header(headers: Column, name: str) -> Column:
    """Value of a header in array<struct<k, v>>, whatever its case; the last of several; null if there is none."""
    named = F.filter(headers, lambda h: F.lower(h["k"]) == name)
    return F.try_element_at(F.transform(named, lambda h: h["v"]), F.lit(-1))


def credential(headers: Column, names: Iterable[str] = CREDENTIAL_HEADERS) -> Column:
    """The first of the credential headers that is not empty."""
    return F.coalesce(*(F.nullif(header(headers, n), F.lit("")) for n in names))


def tenant_id(secret: Column, salt: str = "") -> Column:
    """Sixteen hex digits of the salted hash of a credential; ``anon`` without one."""
    return F.when(F.coalesce(secret, F.lit("")) == "", ANONYMOUS).otherwise(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), secret), 256), 1, 16))


def is_authorized(tenant: Column, allowed: Iterable[str]) -> Column:
    names = list(allowed)
    return tenant.isin(names) if names else F.lit(True)


def node_id(kind: Column | str, text: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat(kind, F.lit("\0"), text), 256), 1, 16))


def prefix_digest(prefix: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}\0"), prefix), 256)
