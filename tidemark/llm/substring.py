"""Removal of word windows that an earlier document has, by super-k-mers (operator 2).

The minimiser of a window of k words is the smallest hash of its runs of m words; consecutive windows of
one minimiser are a super-k-mer.  Equal windows have equal minimisers, so that

1. documents of the same words are one class, of which the smallest doc_id counts;
2. a minimiser that only one class has needs no further look; classes of one slice that share one know it at once;
3. each other super-k-mer travels as one packed string to the bucket of its minimiser, where windows are
   sorted, and those after the first of a run of equal ones are repeats if their doc_id is larger;
4. of equal strings of a batch only those of the smallest doc_id travel, as all windows of the others are repeats;
5. a minimiser that very many classes have is no bucket: its windows travel one by one, dealt by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lean, mix64, saved, signed, temporaries, word_blocks

#: Words of a window, and of the runs that its minimiser is chosen from.
WINDOW, RUN = 13, 5
#: Classes that have a minimiser, from which on its windows are dealt one by one.
CROWD = 10_000
#: Windows of a bucket that are sorted in a task's memory.
BUCKET = 200_000
#: Parts that the rows of one window of a larger bucket are dealt to.
PARTS = 32
_FAR = np.uint64((1 << 64) - 1)
_LENGTH = 32


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def normal(column: pa.Array) -> pa.Array:
    """Each text's words with one space between them, as bytes.  ``bytes.split`` cuts at just the separators of words."""
    return pa.array([b" ".join(x.encode("utf-8", "surrogatepass").split()) if (x := v.as_py()) is not None else b"" for v in column], pa.large_binary())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time, as texts are held in several forms."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def super_kmers(words: Words, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, windows) of each super-k-mer of a block."""
    total = len(words.hash) - window + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = words.windows(run)
    dense = np.full(len(words.hash), _FAR)
    dense[at] = key
    least = dense[:total].copy()
    for i in range(1, window - run + 1):
        np.minimum(least, dense[i : i + total], out=least)
    start = np.flatnonzero(words.doc[:total] == words.doc[window - 1 :])
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    least = least[start]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(start)))
    return least[first], start[first], sizes


def _class(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def whole(docs: DataFrame) -> DataFrame:
    """(id, n, cls, sha) of every row of (id, text): number of words, a part of a digest of all of them, and the digest.

    Rows are copies of each other by the whole digest; ``cls`` tells classes apart where their smallest doc_id is known too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, sha = [], [], []
            for v in batch.column(1):
                words = (v.as_py() or "").encode("utf-8", "surrogatepass").split()
                digest = hashlib.sha256(b" ".join(words))
                n.append(len(words))
                cls.append(_class(digest.digest()))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sha, pa.string())], ["id", "n", "cls", "sha"])

    return docs.select("id", "text").mapInArrow(lean(run), "id long, n long, cls long, sha string")


def minimisers(docs: DataFrame, window: int, run_words: int) -> DataFrame:
    """(deal, mh, cls, n): each minimiser that a text has, once.

    Of the texts of a slice that have a minimiser one stands for all of them, with their number, and is dealt by the minimiser; the others, with 0, share it
    already and are dealt by their class.  A minimiser that very many texts have so meets once for each slice.
    """
    names = ["deal", "mh", "cls", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = normal(batch.column(0))
            cls = np.array([_class(hashlib.sha256(x.as_py()).digest()) for x in texts], np.int64)
            keys, owners = [], []
            for words in word_blocks(texts):
                key, start, _ = super_kmers(words, window, run_words)
                keys.append(key)
                owners.append(cls[words.rows[words.doc[start]]])
            if not keys or not sum(map(len, keys)):
                continue
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            key, owner = key[new], owner[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.zeros(len(key), np.int64)
            n[first] = np.diff(np.append(first, len(key)))
            deal = np.where(n > 0, signed(key), signed(mix64(owner.view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, signed(key), owner, n)], names)

    return docs.where("id is not null").select("text").mapInArrow(lean(run), "deal long, mh long, cls long, n long")


def shared_minimisers(rows: DataFrame, crowd: int, hold: int = 100_000) -> DataFrame:
    """(mh, cls, times) of rows of ``minimisers``: those that another class has too, with 0; and a row for each that more than ``crowd`` have, with how many.

    A class that is in several slices counts for each of them.
    """
    names = ["mh", "cls", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)
        # of a minimiser whose rows were too many to hold: itself, a class, how many have it, and whether several do; the first of such rows
        # come out as shared even if all are of one class, which only costs a look at its windows
        late: tuple[int, int, int, bool] | None = None
        for batch in _with_end(batches):
            if batch is not None:
                mh, cls, n = (batch.column(i).to_numpy() for i in range(1, 4))
                sure = n == 0
                if sure.any():
                    yield pa.RecordBatch.from_arrays([pa.array(mh[sure]), pa.array(cls[sure]), pa.array(n[sure])], names)
                rest = np.concatenate([rest, np.stack([mh[~sure], cls[~sure], n[~sure]])], axis=1)
            if not rest.shape[1]:
                continue
            last = int(np.searchsorted(rest[0], rest[0, -1], "left"))
            cut = rest.shape[1] if batch is None or rest.shape[1] - last > hold else last
            (mh, cls, n), rest = rest[:, :cut], rest[:, cut:]
            if not len(mh):
                continue
            first = np.flatnonzero(np.concatenate([[True], mh[1:] != mh[:-1]]))
            size = np.diff(np.append(first, len(mh)))
            total, low, high = np.add.reduceat(n, first), np.minimum.reduceat(cls, first), np.maximum.reduceat(cls, first)
            several = (low != high) | (np.maximum.reduceat(n, first) > 1)
            if late is not None and mh[0] == late[0]:
                several[0] = several[0] or late[3] or low[0] != late[1]
                total[0] += late[2]
            late = (int(mh[-1]), int(low[-1]), int(total[-1]), bool(several[-1])) if batch is not None and cut > last else None
            many = (total > crowd) & several
            if late is not None:
                many[-1], several[-1] = False, True
            keep = np.repeat(several, size)
            found = [(mh[keep], cls[keep], np.zeros(int(keep.sum()), np.int64)), (mh[first[many]], low[many], total[many])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names)

    return rows.repartition(F.col("deal")).sortWithinPartitions("deal").mapInArrow(lean(run), "mh long, cls long, times long")


def packed(docs: DataFrame, window: int, run_words: int) -> DataFrame:
    """The super-k-mers of (cls, id, wanted and crowded minimisers, text): (deal, words, id, cls, start, n).

    Of equal strings of a batch only those of the smallest id travel with their words, to the bucket of their minimiser;
    the windows of the others are repeats already, and these rows, without words, are dealt evenly.  A string that very many
    documents have so reaches its bucket once for each batch.  Windows of a crowded minimiser are strings of their own, in a bucket of
    their own hash.
    """
    names = ["deal", "words", "id", "cls", "start", "n"]
    salt = np.uint64(0x9E3779B97F4A7C15)

    def found(column: pa.Array, words: Words, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which keys are in the list of their document."""
        lists = [np.asarray(column[int(r)].as_py(), np.int64).view(np.uint64) for r in words.rows]
        owner = np.repeat(np.arange(len(lists), dtype=np.uint64), [len(x) for x in lists])
        return np.isin(mix64(key + doc.astype(np.uint64) * salt), mix64(np.concatenate(lists) + owner * salt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = normal(batch.column(4))
            cls = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            fits = np.array([_class(hashlib.sha256(x.as_py()).digest()) for x in texts], np.int64) == cls
            rows: list[np.ndarray] = []
            strings: list[bytes] = []
            for words in word_blocks(texts):
                key, start, n = super_kmers(words, window, run_words)
                if not len(key):
                    continue
                doc = words.doc[start]
                keep = found(batch.column(2), words, key, doc) & fits[words.rows[doc]]
                key, start, n, doc = key[keep], start[keep], n[keep], doc[keep]
                crowded = found(batch.column(3), words, key, doc)
                if crowded.any():
                    # one row for each window; their hash takes the minimiser's place
                    times = np.where(crowded, n, 1)
                    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    hashes, at = words.windows(window)
                    key, start, n, doc, single = (np.repeat(x, times) for x in (key, start, n, doc, crowded))
                    start, n = start + nth, np.where(single, 1, n)
                    key[single] = hashes[np.searchsorted(at, start[single])]
                first, last = words.start[start].tolist(), words.end[start + n + window - 2].tolist()
                strings += [words.data[a:b].tobytes() for a, b in zip(first, last)]
                row = words.rows[doc]
                rows.append(np.stack([signed(key), ids[row], cls[row], start - words.first[doc], n]))
            if not strings:
                continue
            mh, own, cls_of, start, n = np.concatenate(rows, axis=1)
            least: dict[bytes, int] = {}
            for text, i in zip(strings, own.tolist()):
                if i < least.get(text, i + 1):
                    least[text] = i
            travels = np.array([least[t] for t in strings], np.int64) == own
            deal = np.where(travels, mh, signed(mix64(cls_of.view(np.uint64))))
            sent = pa.array([t.decode("utf-8", "replace") if k else None for t, k in zip(strings, travels.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(deal), sent, *map(pa.array, (own, cls_of, start, n))], names)

    return docs.select("cls", "id", "wanted", "crowded", "text").mapInArrow(lean(run), "deal long, words string, id long, cls long, start long, n long")


def bucket_repeats(rows: DataFrame, window: int, most: int = BUCKET) -> DataFrame:
    """(cls, id, start, n) of the windows of packed rows whose words are in a row of a smaller id, and of the rows without words.

    A task sorts the windows of some buckets at a time.  Those of a bucket of more than ``most`` windows, which texts that repeat themselves may
    make, are told by themselves, and one window's rows are in several tasks.
    """
    names = ["window", "cls", "id", "start", "n"]
    kinds = [pa.string(), *[pa.int64()] * 4]

    def windows(row: tuple) -> Iterator[tuple[str, int]]:
        parts = row[0].split(" ")
        return ((" ".join(parts[p : p + window]), p) for p in range(row[4]))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    def repeats(buckets: list[tuple]) -> list[tuple]:
        entries = sorted((text, row[1], k, p) for k, row in enumerate(buckets) for text, p in windows(row))
        found, word, least = [], None, None
        for text, i, k, p in entries:
            if text != word:
                word, least = text, i
            elif i > least:
                found.append((None, buckets[k][2], i, buckets[k][3] + p, 1))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are (words, id, class, start, windows); a bucket of one string holds no repeat
        full: list[tuple] = []
        bucket: list[tuple] = []
        last, held, size, crowded = None, 0, 0, False
        for batch in batches:
            found = []
            for mh, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row[0] is None:
                    found.append((None, row[2], row[1], row[3], row[4]))
                    continue
                if mh != last:
                    if len(bucket) > 1:
                        full += bucket
                        held += size
                    if held > 20_000:
                        found += repeats(full)
                        full, held = [], 0
                    bucket, last, size, crowded = [], mh, 0, False
                bucket.append(row)
                size += row[4]
                if size > most or crowded:
                    crowded = True
                    for own in bucket:
                        for text, p in windows(own):
                            found.append((text, own[2], own[1], own[3] + p, 1))
                            if len(found) >= 20_000:
                                yield batch_of(found)
                                found = []
                    bucket = []
            yield batch_of(found)
        yield batch_of(repeats(full + (bucket if len(bucket) > 1 else [])))

    schema = "window string, cls long, id long, start long, n long"
    buckets = saved(rows.repartition(F.col("deal")).sortWithinPartitions("deal").mapInArrow(lean(run), schema))
    again = buckets.where("window is not null")
    out = buckets.where("window is null")
    if not again.isEmpty():
        # the smallest id of each window, by partial aggregates, meets the window's rows in several parts
        least = again.groupBy("window").agg(F.min("id").alias("least")).select("window", "least", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        part = F.pmod(F.xxhash64("id", "start"), F.lit(PARTS)).cast("int").alias("part")
        out = out.union(again.select("*", part).join(least, ["window", "part"]).where("id > least").select(out.columns))
    return out.select("cls", "id", "start", "n")


def remove(docs: DataFrame, window: int, digest: bool = False) -> DataFrame:
    """(cls, lo, n_removed, kept) of (cls, id, spans, text): the words left when the windows of the spans are taken out, or their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, removed, kept = [], [], []
            for row, (cls, spans, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                if _class(hashlib.sha256(b" ".join(words)).digest()) != cls:
                    continue
                code = np.asarray(spans.as_py(), np.int64)
                start, n = code >> _LENGTH, code & ((1 << _LENGTH) - 1)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n + window - 1, -1)
                inside = np.cumsum(edge)[:-1] > 0
                left = [w for w, x in zip(words, inside.tolist()) if not x]
                found.append(row)
                removed.append(len(words) - len(left))
                text = b" ".join(left)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["cls", "lo", "n_removed", "kept"])

    return docs.select("cls", "id", "spans", "text").mapInArrow(lean(run), "cls long, lo long, n_removed long, kept string")


def _wanted(docs: DataFrame, classes: DataFrame, window: int, run_words: int, crowd: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(cls, wanted, crowded, id): the minimisers of each class that another class has too, and those of them that very many have."""
    with temporaries() as keep:
        found = saved(shared_minimisers(minimisers(docs, window, run_words), crowd))
        many = found.where("times > 0").select("mh", F.lit(True).alias("many"))
        many = F.broadcast(many) if many.count() <= broadcast_rows else many
        crowded = F.collect_set(F.when(F.col("many"), F.col("mh"))).alias("crowded")
        wanted = found.where("times = 0").join(many, "mh", "left").groupBy("cls").agg(F.collect_set("mh").alias("wanted"), crowded)
        return keep(saved(wanted.join(classes.select("cls", "id"), "cls")))


def _spans(docs: DataFrame, wanted: DataFrame, window: int, run_words: int) -> DataFrame:
    with temporaries() as keep:
        texts = docs.join(wanted, "id").select("cls", "id", "wanted", "crowded", "text")
        spans = bucket_repeats(packed(texts, window, run_words), window)
        code = F.shiftleft("start", _LENGTH) + F.least("n", F.lit((1 << _LENGTH) - 1))
        return keep(saved(spans.groupBy("cls", "id").agg(F.collect_list(code).alias("spans"))))


def repeated_spans(docs: DataFrame, window: int = WINDOW, run_words: int = RUN, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """For (id, text): the rows of ``whole``; and (cls, id, spans) of the classes that have repeats of another class.

    ``id`` is the class's smallest doc_id; a span is ``start << 32 | windows``.
    """
    with temporaries() as keep:
        rows = saved(whole(docs))
        classes = rows.where(f"id is not null and n >= {window}").groupBy("cls", "sha").agg(F.min("id").alias("id"))
        spans = _spans(docs, _wanted(docs, classes, window, run_words, crowd), window, run_words)
        return keep(rows), keep(spans)


def deduplicated(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of (doc_id, text).

    A window of ``window`` words is taken out where its words also start in a document of a smaller
    doc_id, judged on the input.  Null and empty texts have no words, texts shorter than a window are kept
    whole, and so is a row with a null doc_id, which neither removes nor loses words.  Rows of one
    doc_id never remove each other's words.  Texts of any length are read whole.  An empty table gives an empty result; other
    columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows, spans = repeated_spans(own, window, crowd=crowd)
    cut = remove(own.join(spans, "id"), window, digest=True).dropDuplicates(["cls", "lo"])
    cut = cut.select(F.col("cls").alias("_c"), F.col("lo").alias("_i"), "n_removed", F.col("kept").alias("kept_sha256"))
    classes = rows.where(f"id is not null and n >= {window}").groupBy("sha").agg(F.min("id").alias("lo")).withColumnRenamed("sha", "_l")
    out = rows.join(classes, rows["sha"] == F.col("_l"), "left").join(cut, (rows["cls"] == F.col("_c")) & (F.col("lo") == F.col("_i")), "left")
    copy = F.col("id") > F.col("lo")
    some = F.col("id").isNotNull() & F.col("n_removed").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).when(some, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(some, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
