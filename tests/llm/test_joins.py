"""Operators 1, 2, 6 and 10 against brute force, with hot groups, nulls, ties and odd columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import covertree, decontam, ngramjoin, queries, substring
from tidemark.llm.common import word_blocks

from .helpers import documents, edited, near_components, prose, shingle_set, words


def test_ngram_components(spark):
    rng = random.Random(4)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [(i, edited(rng, base, rng.randrange(9))) for i in range(0, 300, 3)]
    texts += [(i, base.upper()) for i in range(1, 60, 3)]
    texts += [(i, prose(rng, 80) + " " + passage) for i in range(2, 90, 3)]
    texts += [(i, edited(rng, prose(random.Random(i // 4), rng.choice([3, 4, 5, 6, 8, 9, 13, 20, 40])), rng.randrange(2))) for i in range(400, 700)]
    texts += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c"), (906, "a  b\tc"), (907, "x " * 400), (908, "x " * 9)]
    docs = documents(spark, texts).withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.components(docs).collect()}
    assert got == near_components(texts)


def test_long_lists_are_not_paired(spark):
    """An element in few documents of each of many tasks is settled like a frequent one."""
    rng = random.Random(14)
    passage, base = prose(rng, 40), prose(rng, 90)
    texts = [(i, f"{passage} {prose(rng, 6)}") for i in range(150)] + [(1000 + i, edited(rng, f"{passage} {base}", rng.randrange(8))) for i in range(150)]
    texts += [(2000 + i, edited(rng, prose(random.Random(i // 100), 7), 0)) for i in range(300)]
    want = near_components(texts)
    docs = documents(spark, texts)
    for parts in (3, 60):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.components(docs.repartition(parts)).collect()}
        assert got == want
    own = docs.repartition(60).selectExpr("doc_id id", "doc_id comp", "text")
    signatures = ngramjoin.prefixes(own, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 12, 75)
    rows = ngramjoin.light_pairs(signatures, 75)
    keys = signatures.groupBy("key").count().collect()
    longest = ngramjoin.LONGEST
    assert rows.where("hot").count() == sum(r["count"] for r in keys if r["count"] > longest) > 1000
    assert rows.where("not hot").count() <= sum(r["count"] * (r["count"] - 1) // 2 for r in keys if r["count"] <= longest)


def test_counters_are_bounded(spark):
    rng = random.Random(24)
    common = prose(rng, 12)
    docs = documents(spark, [(i, f"{prose(rng, 30)} {common}") for i in range(200)]).selectExpr("doc_id id", "text").coalesce(1)
    for counters in (10, 100, 1 << 19):
        counts = ngramjoin.summaries(docs, counters=counters).where("n is null").collect()
        assert len(counts) == 8 and all(r["m0"] <= 200 for r in counts)
    assert all(r["m0"] == 200 for r in counts)


def test_lists_over_several_batches(spark):
    rows = [(k, i, i, 10) for k, n in enumerate([1, 2, 48, 49, 500, 3, 49, 1, 700]) for i in range(n)]
    frame = spark.createDataFrame([(*r, False, r[0]) for r in rows] + [(99, i, i, 10, True, i) for i in range(5)], "key long, id long, comp long, n long, hot boolean, deal long").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (7, 50, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = ngramjoin.light_pairs(frame, 75).collect()
        assert Counter(r["a"] for r in got if r["hot"]) == {3: 49, 4: 500, 6: 49, 8: 700, 99: 5}
        pairs = Counter((r["a"], r["b"]) for r in got if not r["hot"])
        assert pairs == Counter((i, j) for n in (2, 48, 3) for j in range(n) for i in range(j))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_copies_of_one_component_are_not_compared(spark, monkeypatch):
    """A family of very many copies and a few others: blocks of the copies meet only the others."""
    rng = random.Random(15)
    base = prose(rng, 60)
    texts = [(i, edited(rng, base, 1)) for i in range(400)] + [(1000 + i, edited(rng, base, 6)) for i in range(60)]
    docs = documents(spark, texts)
    seen = []
    whole = ngramjoin.heavy_links
    monkeypatch.setattr(ngramjoin, "heavy_links", lambda rows, own, least: seen.append(1) or whole(rows, own, least, block=16))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.components(docs).collect()}
    assert got == near_components(texts) and seen


def test_ngram_odd_rows(spark):
    text = "a b c d e f g"
    docs = documents(spark, [(5, text), (5, text), (7, text), (None, text), (None, None)])
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngramjoin.components(docs).collect())
    assert got == [("5", 3, 5), ("5", 3, 5), ("7", 3, 5), ("None", 0, None), ("None", 3, None)]
    assert ngramjoin.components(documents(spark, [])).count() == 0


def test_boundary_is_cheapest():
    assert ngramjoin.boundary([], 75) == 1
    small = ngramjoin.boundary([(n, 100) for n in range(2, 90)], 75)
    assert 8 <= small <= 40


def brute_removal(texts, k=13):
    first = {}
    for i, t in texts:
        if i is not None:
            w = words(t)
            for p in range(len(w) - k + 1):
                key = tuple(w[p : p + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in texts:
        w = words(t)
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def test_substrings(spark):
    rng = random.Random(6)
    base, passage = prose(rng, 90, 50), prose(rng, 30)
    texts = [(i, edited(rng, base, rng.randrange(4))) for i in range(0, 90, 3)]
    texts += [(i, f"{prose(rng, 20)} {passage}\n{prose(rng, 15, 3)}") for i in range(1, 90, 3)]
    texts += [(i, base) for i in range(2, 40, 3)] + [(200, base.replace(" ", "\t\n ")), (201, base.replace(" ", "\xa0"))]
    texts += [(300, "y " * 60), (301, "y " * 12), (302, "y " * 13), (303, None), (304, ""), (305, base.upper()), (None, base), (306, passage + " " + passage)]
    texts += [(7, passage), (7, passage), (7, passage + " tail"), (400, "é漢 " * 20), (401, "é漢\x85 " * 3 + "é漢 " * 20)]
    docs = documents(spark, texts).withColumn("n_words", F.lit(1)).withColumn("id", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicated(docs).collect())
    assert got == brute_removal(texts)
    assert substring.deduplicated(documents(spark, [])).count() == 0


def test_crowded_minimisers_are_dealt_by_window(spark):
    """A common run of five words with differing surroundings: no bucket gets all of its windows."""
    rng = random.Random(16)
    common, passage = "a run of five words", prose(rng, 25)
    texts = [(i, f"{prose(rng, 20, 30)} {common} {prose(rng, 20, 30)} {passage if i % 5 == 0 else ''} {common}") for i in range(160)]
    texts += [(500 + i, texts[i][1]) for i in range(0, 20, 2)] + [(700, f"{common} " * 30), (701, f"{common} " * 31)]
    docs = documents(spark, texts).repartition(7)
    for crowd in (0, 20, 10_000):
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicated(docs, crowd=crowd).collect())
        assert got == brute_removal(texts)
    own = docs.selectExpr("doc_id id", "text")
    rows = substring.whole(own)
    classes = rows.groupBy("cls", "sha").agg(F.min("id").alias("id"))

    def largest(crowd):
        wanted = substring._wanted(own, classes, 13, 5, crowd)
        sent = substring.packed(own.join(wanted, "id").select("cls", "id", "wanted", "crowded", "text"), 13, 5)
        return sent.where("words is not null").groupBy("deal").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]

    assert largest(20) < largest(10_000) / 3


def test_large_buckets_are_dealt_again(spark):
    rng = random.Random(17)
    unit = prose(rng, 7)
    texts = [(i, f"{unit} " * (20 + i) + prose(rng, 9)) for i in range(20)] + [(50 + i, prose(random.Random(i % 4), 40, 99)) for i in range(12)]
    own = documents(spark, texts).selectExpr("doc_id id", "text")
    rows = substring.whole(own)
    classes = rows.groupBy("cls", "sha").agg(F.min("id").alias("id"))
    wanted = substring._wanted(own, classes, 13, 5, 10_000)
    sent = substring.packed(own.join(wanted, "id").select("cls", "id", "wanted", "crowded", "text"), 13, 5).persist()

    def found(most):
        out = substring.bucket_repeats(sent, 13, most).collect()
        return sorted((r["id"], r["start"] + k) for r in out for k in range(r["n"]))

    want = found(10**6)
    assert len(want) > 500 and all(found(most) == want for most in (0, 1, 30, 500))
    sent.unpersist()


def test_shared_minimisers(spark):
    """Against counting, for any size of what is held, and with a minimiser that most texts have."""
    rng = random.Random(26)
    common = prose(rng, 14)
    texts = [(i, f"{prose(rng, 16, 40)} {common if i % 3 else ''} {prose(rng, 14, 5)}") for i in range(300)] + [(300 + i, f"{prose(random.Random(i % 5), 30)}") for i in range(10)]
    own = documents(spark, texts).selectExpr("doc_id id", "text").repartition(9)
    rows = substring.minimisers(own, 13, 5).persist()
    holders, slices = {}, Counter()
    for r in rows.collect():
        holders.setdefault(r["mh"], set()).add(r["cls"])
        slices[r["mh"]] += r["n"]
    want = {(m, c) for m, held in holders.items() if len(held) > 1 for c in held}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size, hold in ((10_000, 100_000), (16, 3), (50, 10), (7, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = substring.shared_minimisers(rows, 30, hold).collect()
        pairs = {(r["mh"], r["cls"]) for r in got if r["times"] == 0}
        assert pairs >= want and len(want) > 300 and (pairs == want or hold < 100)
        assert {r["mh"]: r["times"] for r in got if r["times"]} == {m: n for m, n in slices.items() if n > 30 and len(holders[m]) > 1}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows.unpersist()


def test_super_kmers_cover_each_window_once():
    rng = random.Random(1)
    for block in word_blocks(pa.array([prose(rng, n, 5) for n in (0, 12, 13, 14, 200)])):
        _, start, n = substring.super_kmers(block)
        got = [s + i for s, k in zip(start.tolist(), n.tolist()) for i in range(k)]
        want = [p for p in range(len(block.hash) - 12) if block.doc[p] == block.doc[p + 12]]
        assert got == want


def brute_embeddings(rows, least=0.95):
    def fine(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    ok = [i is not None and fine(v) for i, v in rows]
    link = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                link[a][b] = covertree.exact_cosine(np.float32(rows[a][1]), np.float32(rows[b][1])) >= least
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for y in range(n):
                if y not in seen and link[x][y]:
                    seen.add(y)
                    todo.append(y)
        i = rows[a][0]
        least_id = None if i is None else min(rows[x][0] for x in seen)
        out.append((str(i), sum(link[a]), least_id, i is not None and least_id == i))
    return sorted(out, key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    vectors = [(c + rng.normal(size=8) * s).astype(np.float32).tolist() for c in centres for s in (0.02, 0.1, 0.25, 0.4) for _ in range(9)]
    rows = [(i * 3, v) for i, v in enumerate(vectors)]
    rows += [(1, vectors[0]), (2, vectors[0]), (4, [2 * x for x in vectors[0]]), (5, None), (7, []), (8, [0.0] * 8), (10, [1.0, None] * 4), (11, [math.nan] * 8), (13, [math.inf] * 8), (None, vectors[0]), (14, [1.0, 2.0]), (16, [1.0, 2.1]), (17, [-x for x in vectors[0]])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash")).withColumn("label", F.lit(1))
    for block, side in ((4096, 8), (40, 8), (20, 2)):
        got = sorted(((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in covertree.near_duplicates(frame, block=block, side=side).collect()), key=str)
        assert got == brute_embeddings(rows)
    assert covertree.near_duplicates(frame.limit(0)).count() == 0


def check_tree(x, tree):
    """Ranges, covering radii, and the invariants of the levels; how many levels there are."""
    n = len(x)
    assert sorted(tree.order.tolist()) == list(range(n))
    rows = x[tree.order]
    assert (tree.begin[0], tree.end[0]) == (0, n)
    by_level = {}
    for i, (a, b, c, r, level, first, k) in enumerate(zip(tree.begin, tree.end, tree.centre, tree.radius, tree.level, tree.first, tree.count)):
        assert a <= c < b and np.linalg.norm(rows[a:b] - rows[c], axis=1).max() <= r + 1e-6
        assert r <= 2 * level + 1e-6, "what is below a centre is within the radii of all finer levels"
        by_level.setdefault(level, []).append(i)
        if k:
            kids = range(first, first + k)
            assert tree.begin[first] == a and tree.end[first + k - 1] == b and k > 1
            assert all(tree.end[p] == tree.begin[p + 1] for p in kids[:-1])
            assert c in {tree.centre[p] for p in kids}, "levels are nested"
            assert all(np.linalg.norm(rows[tree.centre[p]] - rows[c]) <= 2 * tree.level[p] + 1e-6 and tree.level[p] < level for p in kids), "a centre is covered by its parent"
        else:
            assert b - a == 1 or r <= 2 * level
    for level, nodes in by_level.items():
        c = rows[tree.centre[nodes]]
        gap = covertree.distances(c @ c.T) + 9 * np.eye(len(c))
        assert gap.min() > level - 1e-6, "centres of a level are apart"
    return len(by_level)


def test_cover_tree():
    rng = np.random.default_rng(5)
    x = covertree.unit(np.concatenate([rng.normal(size=(1, 16)) + rng.normal(size=(150, 16)) * s for s in (0.01, 0.02, 0.05, 0.1, 0.3)] * 3 + [np.ones((40, 16))]))
    tree = covertree.build(x)
    assert check_tree(x, tree) >= 5
    back = covertree.Tree.load(tree.dump())
    assert all((getattr(back, f) == getattr(tree, f)).all() for f in ("order", "begin", "end", "centre", "radius", "level", "first", "count"))
    for few in (x[:1], x[:2], np.repeat(x[:1], 5, axis=0)):
        check_tree(few, covertree.build(few))


def test_traversal_prunes_and_finds_all_pairs():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    raw = np.concatenate([c + rng.normal(size=(12, 24)) * s for c, s in zip(centres, [0.01, 0.1, 0.2, 0.25, 0.3, 0.6] * 10)])
    blocks, start = [], 0
    weight = rng.integers(1, 4, len(raw))
    parts = np.array_split(rng.permutation(len(raw)), 3)
    placed = []
    for part in parts:
        tree = covertree.build(covertree.unit(raw[part]), 0.08)
        own = part[tree.order]
        placed.append(own)
        blocks.append(covertree.Block(start, raw[own], weight[own], tree))
        start += len(part)
    placed = np.concatenate(placed)
    links = covertree.Links(len(raw))
    visits = [covertree.dual(links, a, b, 0.95) for i, a in enumerate(blocks) for b in blocks[i:]]
    x = covertree.unit(raw[placed])
    near = x @ x.T >= 0.95
    assert (links.count == near @ weight[placed]).all()
    for i in range(len(x)):
        assert (links.label[near[i]] == links.label[i]).all()
    groups = len(set(links.label.tolist()))
    labels, n = np.arange(len(x)), 0
    while n != len(set(labels.tolist())):
        n = len(set(labels.tolist()))
        for i in range(len(x)):
            labels[near[i]] = labels[np.flatnonzero(near[i])].min()
    assert groups == n
    for name in ("dropped", "whole"):
        assert sum(getattr(v, name) for v in visits) > 500
    assert sum(v.compared for v in visits) < len(x) ** 2 / 20


def test_tree_of_the_test_table(spark):
    """The table's vectors are split down to single ones, and most pairs of nodes are dropped by their bounds."""
    rows = covertree.vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id id", "embedding")).collect()
    raw = np.stack([np.frombuffer(r["v"]) for r in rows])
    tree = covertree.build(covertree.unit(raw), 0.08)
    assert check_tree(covertree.unit(raw), tree) >= 2 and (tree.end - tree.begin == 1).sum() >= 0.9 * len(raw)
    block = covertree.Block(0, raw[tree.order], np.ones(len(raw), np.int64), tree)
    visits = covertree.dual(covertree.Links(len(raw)), block, block, 0.95)
    assert visits.dropped > 0.99 * visits.seen > 0 and visits.compared == 0


def slow_similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def slow_shingles(text):
    w = words(text, True)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def slow_find(docs, items, least=0.75):
    """{(doc_id, item_id): (similarity, first word, words)} of the first of the most similar windows, without a hash."""
    found = {}
    for i, text in docs:
        own = slow_shingles(text)
        for j, item in items:
            other = Counter(slow_shingles(item))
            size = sum(other.values())
            n = min(len(own), size)
            if not n or n < least * size:
                continue
            window, both = Counter(own[:n]), 0
            both = sum((window & other).values())
            for p in range(len(own) - n + 1):
                if p:
                    out, new = own[p - 1], own[p + n - 1]
                    both -= window[out] <= other[out]
                    window[out] -= 1
                    window[new] += 1
                    both += window[new] <= other[new]
                if both >= least * (n + size - both) and both / (n + size - both) > found.get((i, j), (0,))[0]:
                    found[i, j] = (both / (n + size - both), p, n + 4)
    return found


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([5, 8, 13, 30, 30, 70, 70, 200])] + [(20, "a b c"), (21, None), (22, ""), (23, None), (25, "x " * 12), (26, "ab " * 150)]
    items.append((24, items[3][1]))
    clean = [(i, prose(rng, 200)) for i in range(50)]
    dirty = [(100 + i, f"{prose(rng, 40)}\n{items[i % 8][1].upper()} {prose(rng, 40)}") for i in range(70)]
    near = [(300 + i, f"{prose(rng, 40)} {edited(rng, items[5 + i % 3][1], 1)} {prose(rng, 40)}") for i in range(30)]
    partial = [(400, items[5][1].rsplit(" ", 12)[0]), (401, items[5][1].rsplit(" ", 40)[0]), (402, "x " * 11), (403, "ab " * 400)]
    odd = [(500, None), (501, ""), (502, "a b c"), (503, items[3][1]), (503, items[3][1]), (504, f"{items[4][1]} {items[4][1]}")]
    odd.append((505, f"{prose(rng, 30_000)} {items[6][1]} {prose(rng, 30_000)}"))
    rows = clean + dirty + near + partial + odd
    docs = documents(spark, [*rows, (None, items[3][1])]).withColumn("similarity", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = slow_find(rows, items)
    found = decontam.find(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"], r["n_words"]) for r in found if r["doc_id"] is not None}
    assert got == want and len(found) == len(want) + 2 + 2, "the row without an id, and a repeated row, hold two items each"
    assert sorted(r["item_id"] for r in found if r["doc_id"] is None) == [3, 24]
    kept = sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect())
    assert kept == sorted(i for i, _ in rows if i not in {p[0] for p in want})
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.find(docs.limit(0), bench).count() == 0 and decontam.find(docs, bench.limit(0)).count() == 0
    small = {(r["doc_id"], r["item_id"]) for r in decontam.find(docs.where("doc_id = 503 or doc_id = 100"), bench.withColumn("item_id", F.col("item_id").cast("smallint"))).collect()}
    assert small == {p for p in want if p[0] in (503, 100)}
    for kind in ("decimal(20,2)", "string", "int"):
        typed = decontam.find(docs.where("doc_id = 503"), bench.withColumn("item_id", F.col("item_id").cast(kind)))
        assert typed.schema["item_id"].dataType.simpleString() == kind and typed.count() == 4
    in_parts = [i for ix in decontam.indexes(bench, block_words=50) for i in ix.ids]
    assert sorted(in_parts) == [0, 1, 2, 3, 4, 5, 6, 7, 24, 25, 26]


def test_many_indexes_find_the_same(spark, monkeypatch):
    rng = random.Random(18)
    items = [(i, prose(rng, 12 + i)) for i in range(12)]
    docs = documents(spark, [(i, f"{prose(rng, 30)} {items[i % 12][1]}") for i in range(40)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(decontam.find(docs, bench).collect())
    whole = decontam.indexes
    monkeypatch.setattr(decontam, "indexes", lambda rows, least: whole(rows, least, 60))
    assert sorted(decontam.find(docs, bench).collect()) == one and len(one) == 40
    assert decontam.clean(docs, bench).count() == 0


def test_recall_at_the_least_similarity():
    """Pairs whose similarity is from 0.75 to 0.8, where fingerprints differ most."""
    rng = random.Random(19)
    pairs, missed = 0, 0
    for _ in range(1500):
        item = prose(rng, rng.randrange(20, 60))
        text = edited(rng, item, rng.randrange(1, 3))
        similar = max([s for s, _, _ in slow_find([(0, text)], [(0, item)]).values()], default=0)
        if similar <= 0.8 and similar:
            pairs += 1
            (block,) = word_blocks(pa.array([text]), True)
            (whole,) = word_blocks(pa.array([item]), True)
            missed += not decontam.Index([0], [whole.windows(5)[0]]).search(block)
    assert pairs > 100 and missed <= 0.03 * pairs


def test_recall_on_the_test_table(spark):
    """Against all windows of all documents by words alone, with no hash."""
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    want = slow_find(docs, items)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"], r["n_words"]) for r in queries.op1_decontaminate(spark, path).collect()}
    assert want and got.items() <= want.items() and len(got) >= 0.9 * len(want)


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    shingles = [rng.integers(0, 2**63, 30, dtype=np.uint64) for _ in range(100)]
    index = decontam.Index(list(range(100)), shingles)
    prints = []
    for item in range(0, 100, 3):
        for changed in (0, 5, 12, 16, 17, 18, 24, 30):
            bits = rng.choice(64, changed, replace=False)
            prints.append(index.prints[item] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0)))
    prints = np.array(prints, np.uint64)
    got = dict((item, near.tolist()) for item, near in index.near(30, prints))
    assert got == {i: np.flatnonzero(np.bitwise_count(prints ^ index.prints[i]) <= index.radius).tolist() for i in range(100)}


def test_blocks_are_selective():
    """Of unrelated pairs few are candidates, and hardly any is within the radius."""
    rng = np.random.default_rng(7)
    index = decontam.Index(list(range(50)), [rng.integers(0, 2**63, 30, dtype=np.uint64) for _ in range(50)])
    prints = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    ((group, tables),) = index.tables[30]
    parts = prints.view(np.uint16).reshape(-1, 4)
    mask = tables[0][parts[:, 0]] | tables[1][parts[:, 1]] | tables[2][parts[:, 2]] | tables[3][parts[:, 3]]
    assert sum(n + 1 for n in index.changed) == index.radius + 1
    assert np.bitwise_count(mask).sum() < 0.11 * len(prints) * 50
    assert sum(len(near) for _, near in index.near(30, prints)) < 0.0005 * len(prints) * 50


def test_fingerprints_of_windows_of_any_size():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 2**63, 9000, dtype=np.uint64)
    keys[100:700] = keys[100]
    sums = decontam.Sums(keys)
    bits = np.unpackbits(keys.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int) * 2 - 1
    for size in (1, 11, 127, 128, 600, 9000, 9001):
        got = sums.windows(size)
        assert len(got) == max(0, 9001 - size)
        for at in {0, 50, 101, len(got) // 2, len(got) - 1} & set(range(len(got))):
            want = np.packbits(bits[at : at + size].sum(axis=0) > 0, bitorder="little").view(np.uint64)[0]
            assert got[at] == want


def test_blocks_meet_in_waves(spark, monkeypatch):
    """Blocks that meet many others travel a bounded number of bytes at a time, and every two still meet."""
    rng = random.Random(16)
    passage = prose(rng, 40)
    texts = [(i, edited(rng, f"{passage} {prose(random.Random(i // 2), 12)}", i % 2)) for i in range(240)]
    own = documents(spark, texts).selectExpr("doc_id id", "text")
    heavy = spark.createDataFrame([(1, i, i, len(shingle_set(t))) for i, t in texts], "key long, id long, comp long, n long")
    written = []
    whole = ngramjoin.saved
    monkeypatch.setattr(ngramjoin, "saved", lambda df: written.append(df.columns) or whole(df))
    found = {}
    for limit in (1 << 30, 1):
        del written[:]
        links = [(r["a"], r["b"]) for r in ngramjoin.heavy_links(heavy, own, 75, block=16, wave_bytes=limit).collect()]
        found[limit] = written.count(["a", "b"])
        least = {i: i for i, _ in texts}
        for _ in texts:
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        assert least == {i: c for i, (_, c) in near_components(texts).items()}
    assert found[1 << 30] == 1 and found[1] > 3


def test_short_lists_of_frequent_elements_are_paired(spark, monkeypatch):
    """Elements that a task has often, but that few sets have among their rarest, need no blocks of whole sets."""
    rng = random.Random(17)
    halves = [[prose(rng, 60) for _ in range(4)] for _ in range(2)]
    texts = [(4 * i + j, f"{a} {b}") for i, a in enumerate(halves[0]) for j, b in enumerate(halves[1])]
    texts += [(100 + i, edited(rng, texts[i][1], 6)) for i in range(0, 16, 3)] + [(1000 + i, prose(rng, 60)) for i in range(200)]
    settled = []
    whole = ngramjoin.heavy_links
    monkeypatch.setattr(ngramjoin, "heavy_links", lambda rows, own, least: settled.append(rows.count()) or whole(rows, own, least))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.components(documents(spark, texts).coalesce(1)).collect()}
    assert got == near_components(texts) and settled == [0]


def test_lists_are_paired_as_far_as_pairs_go(spark):
    lists = {1: 3, 2: 4, 3: 5, 4: 60, 5: 4, 6: 100}
    rows = [(k, 100 * k + i, 0 if k == 5 else i, 10 if k == 3 and not i else 20) for k, n in lists.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "key long, id long, comp long, n long")
    for most, cap, short, bound in ((8, 4096, set(), 1), (9, 4096, {1, 2}, 4), (2000, 4096, {1, 2, 4}, 64), (10**6, 64, {1, 2, 4}, 64), (10**6, 4096, {1, 2, 4, 6}, 128)):
        shorter, longer, longest = ngramjoin.by_length(frame, 12, most, cap)
        got = [Counter(r["key"] for r in x.collect()) for x in (shorter, longer)]
        assert got == [{k: lists[k] for k in short}, {k: lists[k] for k in {1, 2, 3, 4, 6} - short}] and longest == bound
