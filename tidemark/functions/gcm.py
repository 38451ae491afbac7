"""AES-256-GCM of byte strings, for files whose blocks a Python worker writes and reads; columns use Spark's own ``aes_encrypt``."""

from __future__ import annotations

import functools
import hmac

import numpy as np

from .crypto import KEY_BYTES, NONCE_BYTES, TAG_BYTES, AuthenticationError

ROUNDS = 14
#: What a carry out of AES's field, and out of that of the tag, is reduced by.
BYTE_REDUCTION, TAG_REDUCTION = 0x1B, 0xE1 << 120


def _double(x: np.ndarray) -> np.ndarray:
    return (x << 1 ^ np.where(x & 0x80, BYTE_REDUCTION, 0)).astype(np.uint8)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The substitution of bytes, by inverses in the field and the affine map, and the doubles of bytes."""
    every = np.arange(256, dtype=np.uint8)
    doubles = _double(every)
    # powers of 3, which reach every byte but 0
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x ^= int(doubles[x])
    inverse = np.zeros(256, np.uint8)
    for i, p in enumerate(powers):
        inverse[p] = powers[-i % 255]
    box = inverse.copy()
    for turn in range(1, 5):
        box ^= inverse << turn | inverse >> (8 - turn)
    return box ^ np.uint8(0x63), doubles


@functools.lru_cache(64)
def _round_keys(key: bytes) -> np.ndarray:
    box, doubles = _tables()
    words = [np.frombuffer(key, np.uint8)[4 * i : 4 * i + 4] for i in range(8)]
    constant = 1
    for i in range(8, 4 * (ROUNDS + 1)):
        word = words[-1]
        if i % 8 == 0:
            word = box[np.roll(word, -1)] ^ np.array([constant, 0, 0, 0], np.uint8)
            constant = int(doubles[constant])
        elif i % 8 == 4:
            word = box[word]
        words.append(words[-8] ^ word)
    return np.concatenate(words).reshape(ROUNDS + 1, 16)


def _encrypted(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """Blocks of 16 bytes, all of them side by side."""
    box, doubles = _tables()
    keys = _round_keys(key)
    shift = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
    state = blocks ^ keys[0]
    for turn in range(1, ROUNDS + 1):
        state = box[state][:, shift]
        if turn < ROUNDS:
            column = state.reshape(-1, 4, 4)
            after = np.roll(column, -1, axis=2)
            every = np.bitwise_xor.reduce(column, axis=2, keepdims=True)
            state = (column ^ every ^ doubles[column ^ after]).reshape(-1, 16)
        state = state ^ keys[turn]
    return state


def _stream(key: bytes, nonce: bytes, size: int, first: int) -> bytes:
    count = -(-size // 16)
    blocks = np.empty((count, 16), np.uint8)
    blocks[:, :12] = np.frombuffer(nonce, np.uint8)
    blocks[:, 12:] = (np.arange(first, first + count, dtype=np.uint32).astype(">u4")).view(np.uint8).reshape(-1, 4)
    return _encrypted(key, blocks).tobytes()[:size]


@functools.cache
def _carries() -> list[int]:
    """What is left of each low byte when a number is moved by eight places."""
    found = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (TAG_REDUCTION if x & 1 else 0)
        found.append(x)
    return found


@functools.lru_cache(64)
def _multiples(key: bytes) -> list[int]:
    """The products of the hash's key and each byte."""
    power = int.from_bytes(_encrypted(key, np.zeros((1, 16), np.uint8)).tobytes(), "big")
    steps = []
    for _ in range(8):
        steps.append(power)
        power = power >> 1 ^ (TAG_REDUCTION if power & 1 else 0)
    found = [0] * 256
    for byte in range(1, 256):
        low = byte & -byte
        found[byte] = found[byte ^ low] ^ steps[8 - low.bit_length()]
    return found


def _tag(key: bytes, nonce: bytes, bound: bytes, sealed: bytes) -> bytes:
    carries, multiples = _carries(), _multiples(key)
    padded = b"".join(x + bytes(-len(x) % 16) for x in (bound, sealed))
    padded += (8 * len(bound)).to_bytes(8, "big") + (8 * len(sealed)).to_bytes(8, "big")
    total = 0
    for at in range(0, len(padded), 16):
        product = 0
        for byte in (total ^ int.from_bytes(padded[at : at + 16], "big")).to_bytes(16, "little"):
            product = product >> 8 ^ carries[product & 0xFF] ^ multiples[byte]
        total = product
    mask = int.from_bytes(_stream(key, nonce, 16, 1), "big")
    return (total ^ mask).to_bytes(16, "big")


def sealed(key: bytes, nonce: bytes, bound: bytes, plain: bytes) -> bytes:
    """The encrypted bytes, then a tag over them and what they are bound to."""
    if len(key) != KEY_BYTES or len(nonce) != NONCE_BYTES:
        raise ValueError(f"a key has {KEY_BYTES} bytes and a nonce {NONCE_BYTES}")
    body = np.frombuffer(plain, np.uint8) ^ np.frombuffer(_stream(key, nonce, len(plain), 2), np.uint8)
    return body.tobytes() + _tag(key, nonce, bound, body.tobytes())


def opened(key: bytes, nonce: bytes, bound: bytes, data: bytes) -> bytes:
    """The plain bytes; an error where the key, the nonce, the bound bytes or the data aren't those that were sealed."""
    body, tag = data[:-TAG_BYTES], data[-TAG_BYTES:]
    if len(tag) < TAG_BYTES or not hmac.compare_digest(tag, _tag(key, nonce, bound, body)):
        raise AuthenticationError("a block fails its authentication")
    return (np.frombuffer(body, np.uint8) ^ np.frombuffer(_stream(key, nonce, len(body), 2), np.uint8)).tobytes()
