"""Page digests and keyed seals as Catalyst expressions.

A seal is HMAC-SHA-256 over 'number|k|n|digest', its first 40 bits in base32. The pads of the keys are literals of the plan
and show in explain(): for keys that matter use `seal_arrow`, which keeps them in the closure of an Arrow function.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, functions as F

from attesta.functions.text import canonicalize, once, text

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def page_digest(body: Column) -> Column:
    """K1: SHA-256 of the canonical text, in hexadecimal."""
    return F.sha2(F.encode(canonicalize(body), "UTF-8"), 256)


def base32_of_hex(hexa: Column, letters: int) -> Column:
    """K2: the first `letters` base32 signs (without padding) of bytes given in hexadecimal; up to 8 letters, 40 bits."""
    sign = lambda bits, i: F.substring(F.lit(ALPHABET), F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return once(F.conv(F.substring(hexa, 1, 10), 16, 10).cast("bigint"), lambda bits: F.concat(*[sign(bits, i) for i in range(letters)]))


def pads(secret: str) -> tuple[bytes, bytes]:
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(secret: str, message: Column) -> Column:
    inner, outer = pads(secret)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def message(no: Column, k: Column, n: Column, digest: Column) -> Column:
    return F.concat_ws("|", text(no), text(k), text(n), text(digest))


def seal(keys: Mapping[str, str], kid: Column, no: Column, k: Column, n: Column, digest: Column) -> Column:
    """K3: XXXX-XXXX under the key that `kid` names; null for an unknown key (K5)."""
    out = F.lit(None).cast("string")
    for name, secret in keys.items():
        s = once(base32_of_hex(hmac_sha256(secret, message(no, k, n, digest)), 8), lambda x: F.concat(F.substring(x, 1, 4), F.lit("-"), F.substring(x, 5, 4)))
        out = F.when(kid == name, s).otherwise(out)
    return out


def seal_arrow(keys: Mapping[str, str]):
    """K3 with the keys in the closure: an Arrow function of (kid, message)."""
    held = dict(keys)

    @F.pandas_udf("string")
    def run(kid: pd.Series, msg: pd.Series) -> pd.Series:
        def one(k, m):
            if k not in held or m is None:
                return None
            s = base64.b32encode(hmac.new(held[k].encode(), m.encode(), hashlib.sha256).digest())[:8].decode()
            return f"{s[:4]}-{s[4:]}"

        return pd.Series([one(k, m) for k, m in zip(kid, msg)], dtype=object)

    return run


def seals_equal(a: Column, b: Column) -> Column:
    """K4."""
    return text(a) == text(b)


def current_kid(keys: Mapping[str, str]) -> str:
    """K5: the highest number among the names of the keys."""
    return max(keys, key=int)
