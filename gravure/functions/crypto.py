"""Keyed digests out of sha2: the key is configuration, the message is a column."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a BINARY column, as BINARY. Both pads are plan-time literals."""
    block = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    block = block.ljust(BLOCK, b"\0")
    inner_pad = bytearray(b ^ 0x36 for b in block)
    outer_pad = bytearray(b ^ 0x5C for b in block)
    inner = F.unhex(F.sha2(F.concat(F.lit(inner_pad), message), 256))
    return F.unhex(F.sha2(F.concat(F.lit(outer_pad), inner), 256))


def path_digest(key: bytes, salt: bytes, path: Column, size: int = 32) -> Column:
    """Digest of salt + '/path', cut to `size` bytes."""
    slashed = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    full = hmac_sha256(key, F.concat(F.lit(bytearray(salt)), F.encode(slashed, "UTF-8")))
    return F.substring(full, 1, size) if size < 32 else full
