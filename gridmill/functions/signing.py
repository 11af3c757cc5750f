"""SHA-256 digests and HMAC-SHA256 signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

_BLOCK = 64


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def sign(payload: Column, secret: str | bytes) -> Column:
    """HMAC-SHA256 under one known secret, from two nested built-in digests (no Python per row)."""
    key = secret.encode() if isinstance(secret, str) else secret
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, payload.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def _masked(c: Column, mask: int) -> Column:
    """Every byte of a binary column XOR one byte, as a translation of Latin-1 letters.  ``translate`` drops what becomes letter 0, so 256 stands for it."""
    masked = "".join(chr(b ^ mask or 256) for b in range(256))
    letters = F.translate(F.decode(c, "ISO-8859-1"), "".join(map(chr, range(256))), masked)
    return F.encode(F.replace(letters, F.lit(chr(256)), F.lit("\0")), "ISO-8859-1")


def sign_each(payload: Column | str, secret: Column | str) -> Column:
    """HMAC-SHA256 where every row brings its own secret, from the built-in digests; null where the payload is null.  A null secret leaves
    both pads empty: the result is no signature, but it is not null."""
    payload, secret = (F.col(c) if isinstance(c, str) else c for c in (payload, secret))
    raw = secret.cast("binary")
    key = F.when(F.length(raw) > _BLOCK, F.unhex(F.sha2(raw, 256))).otherwise(raw)

    def pad(mask: int) -> Column:
        return F.coalesce(F.rpad(_masked(key, mask), _BLOCK, bytes([mask])), F.lit(b""))

    inner = F.unhex(F.sha2(F.concat(pad(0x36), payload.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def verified(payload: Column, signature: Column, secret: str | bytes) -> Column:
    return F.coalesce(sign(payload, secret) == F.lower(signature), F.lit(False))
