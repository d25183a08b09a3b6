"""Values at rest: AES-256-GCM bound to their key, rotation, tenant keys, shredding.

A sealed value is version 1, a 12-byte nonce, ciphertext and tag.  Opening
yields null for a wrong key, a changed value or another version; nothing raises.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = b"\x01"
INFO = b"cache-tenant:"


def check_key(key: bytes) -> bytes:
    if len(key) != 32:
        raise ValueError("a cache key has 32 bytes")
    return key


def tenant_key(master: bytes, tenant: str, epoch: int | None = None, info: bytes = INFO) -> bytes:
    """HKDF-SHA256 without salt; an epoch makes a key of its own."""
    told = info + (tenant if epoch is None else f"{tenant}:e{epoch}").encode()
    extracted = hmac.new(bytes(32), check_key(master), hashlib.sha256).digest()
    return hmac.new(extracted, told + b"\x01", hashlib.sha256).digest()


def kms_master(unwrap: Callable[[bytes], bytes], wrapped: bytes) -> bytes:
    """Unwraps the master key once, on the driver; a failure is the caller's."""
    return check_key(unwrap(wrapped))


def seal(body: Column, key: Column, aad: Column, nonce: Column | None = None) -> Column:
    args = [body, key, F.lit("GCM"), F.lit("DEFAULT")]
    made = F.aes_encrypt(*args, nonce if nonce is not None else F.lit(b""), aad)
    return F.concat(F.lit(VERSION), made)


def open_sealed(blob: Column, keys: Iterable[Column], aad: Column) -> Column:
    """The plaintext by the first key that fits (the current one, then earlier ones)."""
    rest = F.substring(blob, F.lit(2), F.octet_length(blob))
    tries = [F.try_aes_decrypt(rest, k, F.lit("GCM"), F.lit("DEFAULT"), aad) for k in keys]
    whole = (F.octet_length(blob) >= 13) & (F.substring(blob, 1, 1) == F.lit(VERSION))
    return F.when(whole, F.coalesce(*tries))


def put_sealed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Cache rows (key, tenant, body) with the body sealed by its tenant's key and bound to its cache key; tenants without a key store nothing."""
    return rows.join(keys, "tenant").withColumn("body", seal(F.col("body"), F.col("dek"), F.col("key").cast("binary"))).drop("dek")


def get_sealed(requests: DataFrame, cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests (key, tenant) with ``hit`` and body: what does not open by the asking tenant's key is a miss."""
    found = requests.join(cache.select("key", F.col("body").alias("sealed")), "key", "left").join(keys, "tenant", "left")
    opened = found.withColumn("body", open_sealed(F.col("sealed"), [F.col("dek")], F.col("key").cast("binary")))
    return opened.withColumn("hit", F.col("body").isNotNull()).drop("dek", "sealed")


def tenant_keys(tenants: DataFrame, master: bytes, shredded: Iterable[str] = (), epochs: DataFrame | None = None) -> DataFrame:
    """(tenant, dek): a key per tenant that is not shredded, derived by built-in functions.

    The extract step of the derivation is one constant, so both pads of the
    expanding HMAC are literals.
    """
    extracted = hmac.new(bytes(32), check_key(master), hashlib.sha256).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in extracted)) for pad in (0x36, 0x5C))
    names = list(shredded)
    rows = tenants.select("tenant").distinct()
    rows = rows.where(~F.col("tenant").isin(names)) if names else rows
    told = F.col("tenant")
    if epochs is not None:
        rows = rows.join(epochs, "tenant", "left")
        told = F.concat(told, F.lit(":e"), F.coalesce("epoch", F.lit(0)).cast("string"))
    data = F.concat(inner, F.lit(INFO), told.cast("binary"), F.lit(b"\x01"))
    return rows.select("tenant", F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(data, 256))), 256)).alias("dek"))
