"""Rows sealed by AES-GCM under a key that a password gives."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EngineError


def key_of(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1, dklen=32)


def _proof(key: bytes) -> str:
    return hmac.new(key, b"engram store", hashlib.sha256).hexdigest()


def new_lock(password: str) -> dict[str, str]:
    """What a store keeps to tell the right password: a salt, and a proof that does not give the key."""
    salt = os.urandom(16)
    return {"salt": base64.b64encode(salt).decode(), "proof": _proof(key_of(password, salt))}


def unlock(lock: dict[str, str], password: str) -> bytes:
    key = key_of(password, base64.b64decode(lock["salt"]))
    if not hmac.compare_digest(_proof(key), lock["proof"]):
        raise EngineError("wrong password")
    return key


def sealed(row: Column, key: bytes, place: str) -> Column:
    """place is bound to the row: rows that are moved to another place do not open."""
    return F.aes_encrypt(F.to_json(row).cast("binary"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), F.lit(place).cast("binary"))


def opened(rows: DataFrame, schema: T.StructType, key: bytes, place: str) -> DataFrame:
    plain = F.aes_decrypt(F.col("sealed"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(place).cast("binary"))
    return rows.select(F.from_json(plain.cast("string"), schema).alias("r")).select("r.*")
