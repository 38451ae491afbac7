"""Secret scan: fixed patterns and a token-efficiency test (operator 9)."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Kinds in the order in which they are listed; ``token`` is the token-efficiency test's.
KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A run that may be random.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hex digits.
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: UUIDs and capital digests (small ones are of kind hex) as a part of a run.
_INNER = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID.pattern}|{'|'.join(f'[0-9A-F]{{{n}}}' for n in sorted(_DIGEST_LENGTHS))})(?![A-Za-z0-9])")
_LEAST_SIZE = 16
_NUMBER = re.compile(r"[0-9+/_=-]+")
#: A word of capitals only, which the vocabulary cuts finer than the same word in lower case.
_CAPITALS = re.compile(r"(?<![A-Za-z])[A-Z]{4,}(?![A-Za-z])")
#: The pattern that splits text before the merges of the vocabulary.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def known_kind(run: str) -> bool:
    """Whether a run is a digest, an identifier or a number, which are no secrets by themselves; names are cleared by their ratio."""
    if _ALL_HEX.fullmatch(run) and len(run) in _DIGEST_LENGTHS:
        return True
    return bool(_UUID.fullmatch(run) or _NUMBER.fullmatch(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns, per kind leftmost and non-overlapping."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def word_tokens(run: str, encoding: tiktoken.Encoding) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a run that have letters or digits; words of capitals are read in lower case.

    Tokens of separators don't count, so that a name isn't dense for having many short words.
    """
    found, at = [], 0
    for token in encoding.encode_ordinary(_CAPITALS.sub(lambda m: m[0].lower(), run)):
        end = at + len(encoding.decode_single_token_bytes(token))
        if run[at].isalnum():
            found.append((at, end))
        at = end
    return found


def dense_windows(run: str, encoding: tiktoken.Encoding, least: float) -> list[tuple[int, int]]:
    """(start, end) in a run: all of it if it has under ``least`` letters and digits a token, else the joined windows that have.

    A window is a stretch of whole tokens with a letter and 16 or more characters, where separators in
    series count as one.  All of them are looked at in one pass: one that ends at a token is dense if
    the excess of characters over ``least`` a token was higher at some start far enough to the left.
    """
    tokens = word_tokens(run, encoding)
    if sum(e - s for s, e in tokens) < least * len(tokens):
        return [(0, len(run))]
    starts: list[tuple[int, float, int, int]] = []
    size, excess, letters, last, ready = 0, 0.0, 0, 0, 0
    best: tuple[int, float, int, int] | None = None
    found: list[tuple[int, int]] = []
    for s, e in tokens:
        size += s > last
        starts.append((size, excess, letters, s))
        size, excess, letters, last = size + e - s, excess + e - s - least, letters + run[s].isalpha(), e
        while ready < len(starts) and size - starts[ready][0] >= _LEAST_SIZE:
            best = starts[ready] if best is None or starts[ready][1] >= best[1] else best
            ready += 1
        if best and excess < best[1] - 1e-9 and letters > best[2]:
            if found and best[3] <= found[-1][1]:
                found[-1] = min(found[-1][0], best[3]), e
            else:
                found.append((best[3], e))
    return found


def token_spans(text: str, encoding: tiktoken.Encoding, least: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Dense stretches of runs, in what the taken spans, UUIDs and digests leave of them."""
    found = []
    first, ends = 0, sorted((s, e) for s, _, e in taken)
    for m in _RUN.finditer(text):
        at, stop = m.span()
        while first < len(ends) and ends[first][1] <= at:
            first += 1
        out = [(s, e) for s, e in ends[first : bisect.bisect_left(ends, (stop, 0))] if e > at]
        for s, e in sorted([*out, *(x.span() for x in _INNER.finditer(text, at, stop)), (stop, stop)]):
            if s - at >= _LEAST_SIZE and not known_kind(text[at:s]):
                found += [(at + i, 3, at + j) for i, j in dense_windows(text[at:s], encoding, least)]
            at = max(at, e)
    return found


_encodings: dict[str, tiktoken.Encoding] = {}


def _digest(ranks: dict[bytes, int]) -> str:
    return hashlib.sha256(b"\n".join(b"%d %s" % (n, token.hex().encode()) for token, n in sorted(ranks.items()))).hexdigest()


def _encoding(ranks: dict[bytes, int], name: str | None = None) -> tiktoken.Encoding:
    """The encoding of a vocabulary; a worker makes that of one digest once."""
    name = name or _digest(ranks)
    if name not in _encodings:
        _encodings[name] = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, least: float = 2.1) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_token of every row.

    Every whole text is scanned, of any length and in time that grows with it; a null or empty one has no spans.  Offsets are code points.
    The driver reads the vocabulary, a file of fixed size, and broadcasts it.  Repeated
    rows give repeated results; other columns are not read.
    """
    vocabulary_ranks = read_ranks(vocabulary)
    name = _digest(vocabulary_ranks)
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary_ranks)
    rows = docs.select(F.col("doc_id"), F.col("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long"
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encodings.get(name) or _encoding(ranks.value, name)
        listed = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = token_spans(text, encoding, least, base)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                for column, x in zip(out, [*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more)), len(more)]):
                    column.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names)

    return rows.mapInArrow(lean(run), schema)
