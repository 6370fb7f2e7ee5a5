"""Digests, keyed digests, fingerprints and byte encodings as column expressions."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(data: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256, 32 bytes. The key is constant, so both of its pads are literals of the plan."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return sha256(F.concat(outer, sha256(F.concat(inner, message.cast("binary")))))


def be32(n: Column) -> Column:
    """4 bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def le32(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(7, 0, -2)]))


def le64(n: Column) -> Column:
    """8 bytes, least significant first."""
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def le16(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 4, "0")
    return F.unhex(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)))


def le_bytes(data: Column) -> Column:
    """A byte string behind its length."""
    data = data.cast("binary")
    return F.concat(le32(F.octet_length(data)), data)


def fingerprint(method: Column, target: Column, body: Column, key: bytes) -> Column:
    """Keyed digest of method, whole target and body, each behind its length, so that fields cannot run together. A null
    field is empty."""
    fields = [F.coalesce(c.cast("binary"), F.lit(b"")) for c in (method, target, body)]
    return hmac_sha256(key, F.concat(*[x for c in fields for x in (be32(F.octet_length(c)), c)]))


def leading_zero_bits(digest: Column) -> Column:
    """Number of zero bits before the first one of a binary value."""
    h = F.lower(F.hex(digest))
    zeros = F.char_length(F.regexp_extract(h, "^0*", 0))
    nibble = F.substr(h, zeros + 1, F.lit(1))
    more = F.when(nibble == "", 0).when(nibble == "1", 3).when(nibble.isin("2", "3"), 2).when(nibble.isin("4", "5", "6", "7"), 1).otherwise(0)
    return (zeros * 4 + more).cast("int")


def secret(name: str, fallback: str, env: Mapping[str, str] | None = None) -> bytes:
    """A 32-byte key from the environment variable ``name`` as 64 hex digits, else a digest of ``fallback``."""
    text = (os.environ if env is None else env).get(name)
    if text is None:
        return hashlib.sha256(fallback.encode()).digest()
    if not re.fullmatch("[0-9a-fA-F]{64}", text):
        raise ValueError(f"{name} must be 64 hex digits")
    return bytes.fromhex(text)
