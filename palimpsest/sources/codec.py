"""Column codecs: JSON, compression and authenticated encryption of payload columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.errors import InvalidValue


class Codec(Protocol):
    def encode(self, value: Column) -> Column: ...

    def decode(self, data: Column) -> Column: ...


@dataclass(frozen=True)
class JsonCodec:
    """A struct as JSON bytes; nulls are left out."""

    ddl: str

    def encode(self, value: Column) -> Column:
        return F.to_json(value, {"ignoreNullFields": "true"}).cast("binary")

    def decode(self, data: Column) -> Column:
        return F.from_json(data.cast("string"), self.ddl)


#: Fixed value: the head of a compressed envelope, then one mode byte (0 raw, 1 LZ4), the raw and the stored length.
LZ4_MAGIC = b"PALZLZ41"


@dataclass(frozen=True)
class Lz4Codec:
    """Envelope of 25 bytes around LZ4, or around the raw bytes where LZ4 would not be smaller.
    Lengths are checked before anything is unpacked."""

    inner: Codec
    max_decoded_bytes: int

    def encode(self, value: Column) -> Column:
        limit = self.max_decoded_bytes

        @F.pandas_udf("binary")
        def pack(values: pd.Series) -> pd.Series:
            import pyarrow as pa

            def one(raw):
                raw = bytes(raw)
                if len(raw) > limit:
                    raise ValueError(f"{len(raw)} bytes exceed the limit of {limit}")
                small = pa.compress(raw, codec="lz4_raw", asbytes=True) if raw else b""
                mode, body = (1, small) if raw and len(small) < len(raw) else (0, raw)
                return LZ4_MAGIC + bytes([mode]) + len(raw).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body

            return values.map(one)

        return pack(self.inner.encode(value))

    def decode(self, data: Column) -> Column:
        limit = self.max_decoded_bytes

        @F.pandas_udf("binary")
        def unpack(values: pd.Series) -> pd.Series:
            import pyarrow as pa

            def one(data):
                data = bytes(data)
                mode, raw, stored = data[8] if len(data) >= 25 else -1, int.from_bytes(data[9:17], "little"), int.from_bytes(data[17:25], "little")
                if data[:8] != LZ4_MAGIC or mode not in (0, 1) or stored != len(data) - 25:
                    raise ValueError("not a compressed envelope")
                if raw > limit:
                    raise ValueError(f"{raw} bytes exceed the limit of {limit}")
                if mode == 0 and raw != stored:
                    raise ValueError("raw length differs")
                return data[25:] if mode == 0 else pa.decompress(data[25:], decompressed_size=raw, codec="lz4_raw", asbytes=True)

            return values.map(one)

        return self.inner.decode(unpack(data))


@dataclass(frozen=True)
class StaticKey:
    """One AES key (16, 24 or 32 bytes) and its id (1 to 64 ASCII characters)."""

    key_id: str
    key: bytes

    def __post_init__(self) -> None:
        if not 1 <= len(self.key_id) <= 64 or not self.key_id.isascii():
            raise InvalidValue("key id must be 1 to 64 ASCII characters")
        if len(self.key) not in (16, 24, 32):
            raise InvalidValue("key must have 16, 24 or 32 bytes")

    def current(self) -> tuple[str, bytes]:
        return self.key_id, self.key

    def known(self) -> dict[str, bytes]:
        return {self.key_id: self.key}


@dataclass(frozen=True)
class KeyRing:
    """Several keys: new rows are written under the current one, rows of the older ones stay readable."""

    keys: tuple[StaticKey, ...]
    current_id: str

    def __post_init__(self) -> None:
        if self.current_id not in self.known() or len(self.known()) < len(self.keys):
            raise InvalidValue("key ids must be unique, and the current one among them")

    def current(self) -> tuple[str, bytes]:
        return self.current_id, self.known()[self.current_id]

    def known(self) -> dict[str, bytes]:
        return {k.key_id: k.key for k in self.keys}


@dataclass(frozen=True)
class EncryptedCodec:
    """AES-GCM by Spark's own functions (JVM side), a fresh random nonce a row. The envelope is the key id
    behind its length and the ciphertext with nonce and tag; the key id and the context are authenticated
    with it. Each row is read with the key that its envelope names."""

    inner: Codec
    keys: StaticKey | KeyRing
    context: bytes
    max_plaintext_bytes: int

    def encode(self, value: Column) -> Column:
        key_id, key = self.keys.current()
        plain = self.inner.encode(value)
        sized = F.when(F.octet_length(plain) <= self.max_plaintext_bytes, plain).otherwise(F.raise_error(F.lit("plaintext exceeds the limit")).cast("binary"))
        head = bytes([len(key_id)]) + key_id.encode()
        body = F.aes_encrypt(sized, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.lit(head + self.context))
        return F.concat(F.lit(head), body)

    def decode(self, data: Column) -> Column:
        size = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
        head = F.substring(data, F.lit(1), size + 1)
        body = F.substring(data, size + 2, F.octet_length(data))
        keys = F.create_map(*[F.lit(x) for pair in self.keys.known().items() for x in pair])
        key = F.element_at(keys, F.substring(data, F.lit(2), size).cast("string"))
        small = F.octet_length(data) <= self.max_plaintext_bytes + 29 + size
        sound = F.when(key.isNotNull() & small, body).otherwise(F.raise_error(F.lit("unknown key or too long")).cast("binary"))
        return self.inner.decode(F.aes_decrypt(sound, key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(head, F.lit(self.context))))
