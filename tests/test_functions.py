"""Codecs, checksums, filters and encryption: known answers, round trips, damage."""

import hashlib
import random

import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import batches, bloom, checksum, crypto, gcm, varint

EDGES = [0, 1, 127, 128, 16383, 16384, 2**32 - 1, 2**32, 2**63 - 1]


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(value):
    data = varint.encode(value)
    assert varint.decode(data + b"rest") == (value, len(data)) == varint.decode_canonical(data)


def test_varint_errors():
    for data, bits in [(b"", 64), (b"\x80", 64), (b"\xff" * 10, 64), (b"\xff" * 9 + b"\x02", 64), (varint.encode(2**32), 32)]:
        with pytest.raises(varint.DecodeError):
            varint.decode(data, 0, bits)
    assert varint.decode(b"\x80\x00") == (0, 2)
    with pytest.raises(varint.DecodeError):
        varint.decode_canonical(b"\x80\x00")


def test_varint_columns(spark):
    rows = spark.createDataFrame([(v,) for v in [*EDGES, -1]], "v long")
    got = rows.select("v", varint.length(F.col("v")), varint.encoded(F.col("v"))).collect()
    for v, n, data in got:
        assert bytes(data) == varint.encode(v % 2**64) and n == len(data)


def test_crc32c_known_answers():
    for data, want in [(b"123456789", 0xE3069283), (bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (b"", 0)]:
        assert checksum.crc32c(data) == want
    assert checksum.crc32c(b"6789", checksum.crc32c(b"12345")) == 0xE3069283
    values = [b"", b"123456789", b"a" * 300, b"b"]
    assert checksum.crc32c_many(values).tolist() == [checksum.crc32c(v) for v in values]


def test_checksum_columns(spark):
    rows = spark.createDataFrame([(b"123456789", 0), (b"123456789", 1), (None, 0), (b"x", 9)], "v binary, a int")
    got = [r[0] for r in rows.select(checksum.checksum_of(F.col("a"), F.col("v"))).collect()]
    digest = xxhash.xxh3_64_intdigest(b"123456789")
    assert got == [0xE3069283, digest - (digest >> 63 << 64), None, None]


@given(st.lists(st.tuples(st.booleans(), st.binary(max_size=47), st.binary(max_size=199)), max_size=15))
def test_batch_round_trip(ops):
    batch = batches.WriteBatch()
    for put, key, value in ops:
        batch.put(key, value) if put else batch.delete(key)
    assert batches.WriteBatch.decode(batch.encode()).ops == batch.ops


@given(st.binary(max_size=64))
def test_batch_decoder_only_raises_value_errors(data):
    try:
        batches.WriteBatch.decode(data)
    except ValueError:
        pass


def test_malformed_batches():
    for data in (b"\x01\x07", b"\x01\x00\x05ab", batches.WriteBatch().put(b"k", b"v").encode() + b"x", varint.encode(batches.MAX_OPS + 1)):
        with pytest.raises(ValueError):
            batches.WriteBatch.decode(data)


def test_batch_columns(spark):
    rows = spark.createDataFrame([(b"a", 3, 0, b"1", 0), (b"b", 3, 1, b"", 1), (b"c", 4, 0, b"", 0)], "key binary, seqno long, op tinyint, value binary, batch_pos int")
    payloads = batches.encoded(rows)
    back = batches.decoded(payloads).orderBy("seqno", "batch_pos").collect()
    assert [(bytes(r["key"]), r["seqno"], r["op"], bytes(r["value"]), r["batch_pos"]) for r in back] == [(b"a", 3, 0, b"1", 0), (b"b", 3, 1, b"", 1), (b"c", 4, 0, b"", 0)]
    assert batches.decoded(spark.createDataFrame([(b"\x01\x09", 1)], "payload binary, seqno long")).first()["error"]


def test_bloom_rates_and_bytes():
    one = bloom.BlockedBloom.sized(10_000)
    for i in range(10_000):
        one.insert(b"k-%08d" % i)
    assert all(one.contains(b"k-%08d" % i) for i in range(0, 10_000, 7))
    assert sum(one.contains(b"miss-%010d" % i) for i in range(20_000)) <= 600
    assert one.pruned >= 19_400
    back = bloom.BlockedBloom.decode(one.encode())
    assert back.encode() == one.encode() and back.contains(b"k-00000001") and back.byte_size == one.byte_size
    for bad in (b"", b"x" * 80, one.encode()[:-1]):
        with pytest.raises(ValueError):
            bloom.BlockedBloom.decode(bad)


def test_bloom_columns_have_the_same_bits(spark):
    keys = [b"key-%d" % i for i in range(300)]
    blocks = bloom.block_count(300)
    one = bloom.BlockedBloom.sized(300)
    for k in keys:
        one.insert(k)
    frame = spark.createDataFrame([(k,) for k in keys], "key binary")
    words = bloom.build(frame, "key", blocks)
    own = one.blocks.view("<i8").tolist()
    got = {(r["block"], r["word"]): r["bits"] for r in words.collect()}
    assert got == {(b, w): v for b, row in enumerate(own) for w, v in enumerate(row) if v}
    asked = spark.createDataFrame([(b"key-%d" % i,) for i in range(1000)], "key binary")
    for r in bloom.probe(asked, "key", words, blocks).collect():
        assert r["maybe"] == one.contains(bytes(r["key"]))


def test_hkdf_known_answer():
    """RFC 5869, test case 1."""
    got = crypto.hkdf_sha256(bytes([0x0B] * 22), bytes(range(0xF0, 0xFA)), 42, bytes(range(13)))
    assert got.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


def test_sealing(spark):
    master = crypto.SecretKey(hashlib.sha256(b"m").digest())
    key = crypto.run_key(master, 1)
    rows = spark.createDataFrame([(i, b"secret-%d" % i) for i in range(20)], "position long, value binary")
    sealed = crypto.seal(rows, "value", key, 1)
    for r in sealed.collect():
        assert len(r["value"]) == crypto.NONCE_BYTES + len(b"secret-%d" % r["position"]) + crypto.TAG_BYTES
    assert sorted(crypto.unseal(sealed, "value", key, 1).collect()) == sorted(rows.collect())
    for other, run in ((crypto.run_key(master, 2), 1), (key, 2)):
        assert {r["value"] for r in crypto.unseal(sealed, "value", other, run).collect()} == {None}
    swapped = sealed.withColumn("position", (F.col("position") + 1) % 20)
    assert {r["value"] for r in crypto.unseal(swapped, "value", key, 1).collect()} == {None}
    assert key.material.hex() not in sealed._jdf.queryExecution().toString().lower() and key.material.hex() not in repr(key)


def test_keys_from_hex():
    assert crypto.SecretKey.from_hex("ab" * 32).material == b"\xab" * 32
    for bad in ("", "ab" * 31, "zz" * 32, " " + "ab" * 32):
        assert crypto.SecretKey.from_hex(bad) is None


def test_damage_changes_checksums():
    rng = random.Random(1)
    data = rng.randbytes(64)
    for bit in range(0, 512, 37):
        other = bytearray(data)
        other[bit // 8] ^= 1 << bit % 8
        assert checksum.crc32c(bytes(other)) != checksum.crc32c(data) and checksum.xxh3(bytes(other)) != checksum.xxh3(data)


def test_varint_decode_columns(spark):
    rng = random.Random(4)
    datas = [varint.encode(v) for v in (*EDGES, 2**64 - 1)] + [b"", b"\x80", b"\x80\x00", b"\x81\x80\x00", b"\xff" * 10, b"\xff" * 9 + b"\x01", b"\xff" * 9 + b"\x02", b"\xff" * 4 + b"\x0f", b"\xff" * 4 + b"\x10", b"\x80" * 5 + b"\x01", b"\x05rest"]
    datas += [rng.randbytes(rng.randrange(1, 12)) for _ in range(300)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(datas)] + [(-1, None)], "i int, d binary")
    for bits in (32, 64):
        for canonical, f in ((False, varint.decode), (True, varint.decode_canonical)):
            for i, got in rows.select("i", varint.decoded(F.col("d"), bits, canonical)).collect():
                try:
                    value, size = f(datas[i], 0, bits) if i >= 0 else (None, None)
                    want = None if value is None else (value - (value >> 63 << 64), size)
                except varint.DecodeError:
                    want = None
                assert (tuple(got) if got else None) == want, (datas[i], bits, canonical)


def test_streamed_digest_and_accessors():
    data = bytes(range(256)) * 9
    state = checksum.Xxh3()
    for at in range(0, len(data), 100):
        state.update(data[at : at + 100])
    assert state.digest() == checksum.xxh3(data) and checksum.Xxh3().digest() == checksum.xxh3(b"")
    one = bloom.BlockedBloom.sized(1000, 12, 5)
    assert (one.num_blocks, one.hashes, one.bits_per_key, one.keys, one.byte_size) == (24, 5, 12, 0, 24 * 64)


def test_batches_of_many_runs(spark):
    rng = random.Random(6)
    rows = [(run, s, p, int(rng.random() < 0.2), b"k%d" % rng.randrange(9), b"v" * rng.randrange(300)) for run in range(3) for s in range(1, 40) for p in range(rng.randrange(1, 9))]
    rows = [(r, s, p, o, k, b"" if o else v) for r, s, p, o, k, v in rows]
    log = spark.createDataFrame(rows, "run_id long, seqno long, batch_pos int, op tinyint, key binary, value binary").repartition(5)
    payloads = batches.encoded(log, "run_id")
    back = [(r["run_id"], r["seqno"], r["batch_pos"], r["op"], bytes(r["key"]), bytes(r["value"])) for r in batches.decoded(payloads, also=("run_id",)).collect()]
    assert sorted(back) == sorted(rows) and payloads.count() == 3 * 39
    assert batches.encoded(log.limit(0)).count() == 0


def test_sealed_bytes_are_those_of_spark(spark):
    rng = random.Random(8)
    rows = [(rng.randbytes(32), rng.randbytes(12), rng.randbytes(rng.choice([1, 16, 17, 40])), rng.randbytes(n)) for n in (1, 15, 16, 17, 31, 64, 1000, 16_389)]
    frame = spark.createDataFrame(rows, "k binary, n binary, a binary, p binary")
    for r in frame.selectExpr("*", "aes_encrypt(p, k, 'GCM', 'DEFAULT', n, a) c").collect():
        k, n, a, p, c = map(bytes, r)
        assert gcm.sealed(k, n, a, p) == c[12:] and gcm.opened(k, n, a, c[12:]) == p
        for i in range(5):
            parts = [bytearray(x) for x in (k, n, a, c[12:])]
            parts[i % 4][rng.randrange(len(parts[i % 4]))] ^= 1 << rng.randrange(8)
            with pytest.raises(crypto.AuthenticationError):
                gcm.opened(*map(bytes, parts))


def test_known_answers_of_gcm():
    """Of the GCM specification's test cases for keys of 256 bits: an empty text, and one block of zeros."""
    assert gcm.sealed(bytes(32), bytes(12), b"", b"").hex() == "530f8afbc74536b9a963b4f1c4cb738b"
    assert gcm.sealed(bytes(32), bytes(12), b"", bytes(16)).hex() == "cea7403d4d606b6e074ec5d3baf39d18" + "d0d1c8a799996bf0265b98b5d48ab919"
    with pytest.raises(crypto.AuthenticationError):
        gcm.opened(bytes(32), bytes(12), b"", b"short")
