"""Language identification by cross-parsing entropy (operator 7).

For each language a suffix automaton of labelled text accepts exactly the
substrings of that text.  A document is parsed greedily into longest matches; the
fewer phrases a language needs, the closer the document is to it.  With z phrases
over n bytes and m bytes of training text, z * log2(m) / n estimates the cross entropy
in bits a byte; the language with the least wins.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

_OTHER = re.compile(r"[\W\d_]+")
#: Bytes of a segment; those of a text are parsed side by side and then joined, so that they don't change the result.
SEGMENT = 1024
#: Bytes of a segment within which its parse nearly always meets that of the text; else the text is parsed again, byte by byte.
JOIN = 256
#: Bytes that are parsed side by side, and rows whose texts are held as such.
AT_ONCE, ROWS = 2 << 20, 2000


def normalised(text: str | None) -> bytes:
    """Lower-case letters, with one space for anything between them; empty without a letter."""
    if not text:
        return b""
    kept = _OTHER.sub(" ", text).lower()
    return kept.encode("utf-8", "replace") if any(map(str.isalpha, kept)) else b""


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton whose paths from state 0 spell the substrings of text."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        here = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = here
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return moves


@dataclass
class Model:
    """Labelled text of each language; the automata are built where they are needed."""

    texts: dict[str, bytes]
    _built: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"texts": self.texts, "_built": None}

    @property
    def langs(self) -> list[str]:
        return sorted(self.texts)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbol of a byte, moves, first state of each language, bits a phrase).

        A move is twice the next state's place in the table, plus 1 where a phrase starts with this byte.  From the
        first state every byte starts one; a byte that the language lacks is a phrase of its own and leads there.
        """
        if self._built is None:
            used = sorted(set().union(*map(set, self.texts.values())))
            symbol = np.full(256, len(used), np.int32)
            symbol[used] = np.arange(len(used))
            width = len(used) + 1
            parts, roots, base = [], [], 0
            for lang in self.langs:
                moves = suffix_automaton(self.texts[lang])
                start = (base + len(moves)) * width
                to = np.full((len(moves) + 1, width), -1, np.int64)
                for i, out in enumerate(moves):
                    for c, j in out.items():
                        to[i, symbol[c]] = (base + j) * width
                # without a move the phrase ends and the next one starts with this byte
                again = np.where(to[0] >= 0, to[0], start) * 2 + 1
                parts.append(np.where(to >= 0, to * 2, again[None, :]).astype(np.int32))
                roots.append(start)
                base += len(moves) + 1
            bits = np.array([math.log2(max(2, len(self.texts[x]))) for x in self.langs])
            self._built = symbol, np.concatenate(parts).ravel(), np.array(roots, np.int32), bits
        return self._built

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases that each language needs for each text.

        Segments are parsed side by side, each as if a phrase started with it.  Then each is entered in the state in which the one before it ended: from the
        first byte on with which a phrase starts either way both parses are the same.
        """
        symbol, moves, roots, _ = self.tables()
        data = symbol[np.frombuffer(b"".join(texts), np.uint8)]
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(first, pieces) + nth * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(sizes, pieces) - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        owner, begin, length, nth = owner[order], begin[order], length[order], nth[order]
        state = np.repeat(roots[:, None], len(owner), axis=1)
        starts = np.zeros(state.shape, np.int32)
        early = np.zeros((*state.shape, JOIN), bool)
        if len(owner):
            active = np.searchsorted(-length, -np.arange(length[0]), "left")
            for t in range(int(length[0])):
                k = int(active[t])
                move = moves.take(state[:, :k] + data[begin[:k] + t])
                begun = move & 1
                starts[:, :k] += begun
                if t < JOIN:
                    early[:, :k, t] = begun
                np.right_shift(move, 1, out=state[:, :k])
        later = np.flatnonzero(nth > 0)
        lang, at = (x.ravel() for x in np.meshgrid(np.arange(len(roots)), later, indexing="ij"))
        now = state[lang, place[order[at] - 1]]
        for t in range(JOIN):
            inside = t < length[at]
            if not inside.all():
                # the text's last segment ends first: its parse is counted whole
                lang, at, now = lang[inside], at[inside], now[inside]
            if not len(at):
                break
            move = moves.take(now + data[begin[at] + t])
            mine, theirs = move & 1, early[lang, at, t]
            starts[lang, at] += mine - theirs
            off = ~((mine == 1) & theirs)
            lang, at, now = lang[off], at[off], move[off] >> 1
        apart = set(zip(lang.tolist(), owner[at].tolist()))
        found = np.zeros((len(texts), len(roots)), np.int64)
        for i in range(len(roots)):
            found[:, i] = np.bincount(owner, starts[i], len(texts))
        for i, text in apart:
            found[text, i] = self._phrases_of(data[first[text] : first[text] + sizes[text]], int(roots[i]))
        return found

    def _phrases_of(self, data: np.ndarray, state: int) -> int:
        """Phrases of one text in the language of a first state, byte by byte."""
        moves, n = self.tables()[1].data, 0
        for symbol in data.tolist():
            move = moves[state + symbol]
            n += move & 1
            state = move >> 1
        return n

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without a letter or a language.

        The score is 1 less the ratio of the least cross entropy to the next one.  Of languages that tie the first by name wins, with score 0.
        """
        clean = [normalised(t) for t in texts]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        names = self.langs
        known = [i for i, t in enumerate(clean) if t] if names else []
        at = 0
        while at < len(known):
            stop, total = at, 0
            while stop < len(known) and (stop == at or total + len(clean[known[stop]]) <= AT_ONCE):
                total += len(clean[known[stop]])
                stop += 1
            block = known[at:stop]
            cost = self.phrases([clean[i] for i in block]) * self.tables()[3]
            best = cost.argmin(axis=1)
            two = np.sort(cost, axis=1)[:, :2]
            for i, b, pair in zip(block, best.tolist(), two.tolist()):
                langs[i] = names[b]
                scores[i] = 1.0 - pair[0] / pair[1] if len(pair) > 1 else 1.0
            at = stop
        return langs, scores


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _cut(text: bytes, size: int) -> bytes:
    """The first bytes of a text, up to the end of a character."""
    return text[:size].decode("utf-8", "ignore").encode() if len(text) > size else text


def fit(docs: DataFrame, max_bytes: int = 16_000, max_docs: int = 60, least_bytes: int = 256) -> Model:
    """Learns every language from a bounded sample of the labelled rows of (doc_id, text, lang).

    All rows with a label, an id and a letter can be in the sample, whatever their size; only those of
    the held-out fold can't.  Each language is learned from up to ``max_bytes`` bytes, less if there are
    more than 8 (all together hold at most 8 * ``max_bytes``), but ``least_bytes`` in any case.
    They are filled in the order of a hash of doc_id from the first rows, ``max_docs`` or one for each 32
    bytes: short texts whole, of long ones the start from the first letter on, up to an eighth of the bytes.
    """
    labelled = docs.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).where(fold(F.col("doc_id")) != 2)
    ids_of = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id")).collect()}
    langs = list(ids_of)
    if not langs:
        return Model({})
    each = max(least_bytes, min(max_bytes, 8 * max_bytes // len(langs)))
    excerpt = each // 8
    most = max(max_docs, each // 32)
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    # far more ids than are wanted have a hash below this, so that few rows of a language are sorted, however many there are
    below = F.create_map(*[F.lit(x) for lang, n in ids_of.items() for x in (lang, float(min(1 << 32, (8 * most << 32) // max(1, n))))])
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id", F.lit("langid")).alias("_h"), F.least(F.octet_length("text"), F.lit(excerpt)).alias("_size"))
    ids = ids.where(F.call_function("shiftrightunsigned", "_h", F.lit(32)) < F.element_at(below, F.col("lang")))
    ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    chosen, sizes = [], dict.fromkeys(langs, 0)
    for lang, _, doc, size in sorted((r[1], r[2], r[0], r[3]) for r in ids.select("doc_id", "lang", "_h", "_size").collect()):
        # twice the bytes, as texts may shrink when they are normalised
        if sizes[lang] < 2 * each:
            chosen.append((lang, doc))
            sizes[lang] += size
    start = F.substring(F.regexp_replace("text", r"(?s)^\P{L}+", ""), 1, excerpt).alias("text")
    rows = labelled.where(F.col("doc_id").isin(sorted({c[1] for c in chosen}))).select("doc_id", "lang", start)
    texts: dict[tuple, str] = {}
    for doc, lang, text in rows.groupBy("doc_id", "lang").agg(F.max("text")).collect():
        texts[doc, lang] = text
    found: dict[str, bytes] = {}
    for lang, doc in dict.fromkeys(chosen):
        have = found.get(lang, b"")
        found[lang] = _cut(have + b" " * bool(have) + _cut(normalised(texts[doc, lang]), excerpt), each)
    return Model(found)


_models: dict[str, Model] = {}


def _local(model: Model) -> Model:
    """The same model, so that a worker builds its automata once."""
    name = hashlib.sha256(repr(sorted(model.texts.items())).encode()).hexdigest()
    return _models.setdefault(name, model)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to the columns of docs, from the whole ``text`` alone.

    A null or empty text, or one without a letter, is ``und`` with score 0.  A text of any length is parsed whole.  Row order,
    repeated rows and other columns don't matter; columns named lang_pred or score
    are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text_at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _local(model)
        for batch in batches:
            langs, scores = [], []
            for lo in range(0, batch.num_rows, ROWS):
                found = own.predict(batch.column(text_at).slice(lo, ROWS).to_pylist())
                langs += found[0]
                scores += found[1]
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return source.mapInArrow(lean(run), schema)


def known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose ``text`` has a predicted language: all but those that are ``und``.

    A model without a language tells nothing of a text, so that all rows with a letter stay.
    """
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _local(model)
        for batch in batches:
            kept = []
            for lo in range(0, batch.num_rows, ROWS):
                texts = batch.column(text_at).slice(lo, ROWS).to_pylist()
                kept += [x != "und" for x in own.predict(texts)[0]] if own.texts else [bool(normalised(t)) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the other folds."""
    model = fit(docs)
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
