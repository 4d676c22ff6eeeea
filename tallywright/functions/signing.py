"""Keyed digests and fingerprints as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lowercase hex of HMAC-SHA256 of a binary column, with built-in functions only."""
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def fingerprint(*parts: Column) -> Column:
    """One digest of several values; nulls and empty strings differ, and so do ("a", "bc") and ("ab", "c")."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(s := p.cast("string")).cast("string"), F.lit(":"), s), F.lit("-")) for p in parts]), 256)
