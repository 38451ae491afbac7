"""Encryption at rest: a key for each run, a nonce for each row or block, and bound coordinates."""

from __future__ import annotations

import hashlib
import hmac
import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the first four bytes of a nonce, little-endian.
NONCE_TAG = 0x43464F4E
KEY_BYTES, NONCE_BYTES, TAG_BYTES = 32, 12, 16


class AuthenticationError(ValueError):
    """A key that isn't the one that sealed."""


@dataclass(frozen=True)
class SecretKey:
    """A key whose text never shows it."""

    material: bytes

    def __post_init__(self):
        if len(self.material) != KEY_BYTES:
            raise ValueError(f"a key has {KEY_BYTES} bytes")

    def __repr__(self) -> str:
        return f"SecretKey({len(self.material)} bytes)"

    @classmethod
    def from_hex(cls, text: str) -> SecretKey | None:
        """The key of 64 hex digits; none for any other text."""
        try:
            material = bytes.fromhex(text)
        except ValueError:
            return None
        return cls(material) if len(text) == 2 * KEY_BYTES == 2 * len(material) else None


def hkdf_sha256(material: bytes, info: bytes, size: int = KEY_BYTES, salt: bytes = b"") -> bytes:
    """HKDF of RFC 5869."""
    pseudo = hmac.digest(salt or bytes(32), material, hashlib.sha256)
    out = block = b""
    while len(out) < size:
        block = hmac.digest(pseudo, block + info + bytes([len(out) // 32 + 1]), hashlib.sha256)
        out += block
    return out[:size]


def run_key(master: SecretKey, run_id: int, prefix: bytes = b"tidemark:run:v1:") -> SecretKey:
    """The key of one run; another ``prefix`` gives the keys of another store's files."""
    return SecretKey(hkdf_sha256(master.material, prefix + struct.pack("<Q", run_id)))


def key_check(master: SecretKey, salt: str) -> str:
    """A digest that tells whether a key is the right one, and nothing else about it."""
    own = hkdf_sha256(master.material, b"tidemark:check:v1")
    return hmac.digest(own, salt.encode(), hashlib.sha256).hex()


def nonce(position: Column) -> Column:
    """12 bytes that are unique for a position within a run."""
    return F.unhex(F.concat(F.lit(struct.pack("<I", NONCE_TAG).hex()), _little(position)))


def bound(run_id: Column, position: Column) -> Column:
    """16 bytes that bind a text to its run and position."""
    return F.unhex(F.concat(_little(run_id), _little(position)))


def _little(value: Column) -> Column:
    """Hex of a BIGINT's 8 bytes, the lowest first."""
    big = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)])


def seal(df: DataFrame, column: str, key: SecretKey, run_id: int, position: str = "position") -> DataFrame:
    """``column`` encrypted as nonce, text and tag (AES-256-GCM).

    The key reaches the executors as a broadcast variable that a UDF reads, so that it is in no plan text or log.
    """
    sealed = F.expr(f"aes_encrypt({column}, _key, 'GCM', 'DEFAULT', _nonce, _bound)")
    return _with_key(df, key, run_id, position).withColumn(column, sealed).drop("_key", "_nonce", "_bound")


def unseal(df: DataFrame, column: str, key: SecretKey, run_id: int, position: str = "position") -> DataFrame:
    """``column`` decrypted; null where the key, the run or the position isn't that of the text."""
    own = F.expr(f"substring({column}, 1, {NONCE_BYTES})") == F.col("_nonce")
    plain = F.when(own, F.expr(f"try_aes_decrypt({column}, _key, 'GCM', 'DEFAULT', _bound)"))
    return _with_key(df, key, run_id, position).withColumn(column, plain).drop("_key", "_nonce", "_bound")


def _key_column(df: DataFrame, key: SecretKey | dict[int, SecretKey], column: str) -> DataFrame:
    """df with the key in ``_key``, from a broadcast variable by way of a UDF, so that no plan or log shows it.

    Of several keys it is the one that ``column`` names; one key is that of every row.
    """
    many = isinstance(key, dict)
    shared = df.sparkSession.sparkContext.broadcast({n: k.material for n, k in key.items()} if many else key.material)

    @F.pandas_udf(T.BinaryType())
    def material(rows: pd.Series) -> pd.Series:
        return pd.Series([shared.value[n] for n in rows] if many else [shared.value] * len(rows))

    return df.withColumn("_key", material(F.col(column)))


def _with_key(df: DataFrame, key: SecretKey, run_id: int, position: str) -> DataFrame:
    df = _key_column(df, key, position)
    return df.withColumn("_nonce", nonce(F.col(position))).withColumn("_bound", bound(F.lit(run_id), F.col(position)))


def _record_bound(run_id: str) -> str:
    """SQL for the bytes that bind a value to its run (SQL too), its number, its place in the batch, its operation and its key."""
    return f"encode(concat_ws(':', {run_id}, seqno, op, batch_pos, hex(key)), 'UTF-8')"


def seal_records(rows: DataFrame, key: SecretKey, run_id: int) -> DataFrame:
    """``value`` of a log's records encrypted, each under a random nonce, and bound to all else that the record holds."""
    sealed = F.expr(f"aes_encrypt(value, _key, 'GCM', 'DEFAULT', unhex(''), {_record_bound(str(run_id))})")
    return _key_column(rows, key, "seqno").withColumn("value", sealed).drop("_key")


def unseal_records(rows: DataFrame, keys: dict[int, SecretKey]) -> DataFrame:
    """``value`` decrypted by the key of the row's ``run_id``; a value that another key sealed, or that was changed or moved, fails the job."""
    plain = F.expr(f"try_aes_decrypt(value, _key, 'GCM', 'DEFAULT', {_record_bound('run_id')})")
    wrong = F.raise_error(F.lit("a value fails its authentication")).cast("binary")
    opened = _key_column(rows, keys, "run_id").withColumn("value", F.when(F.col("value").isNotNull(), F.coalesce(plain, wrong)))
    return opened.drop("_key")
