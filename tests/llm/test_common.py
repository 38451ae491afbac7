import glob
import random
import time

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, discard, running_offsets, saved, shared_dir, stored, temporaries, word_blocks

from .helpers import LOWER, words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x0c\r\x85\xa0é漢", max_size=40)), max_size=12), st.booleans(), st.sampled_from([1, 7, 1000]))
def test_words(texts, lower, size):
    seen, hashes = [], {}
    for block in word_blocks(pa.array(texts, pa.string()), lower, size):
        for d in range(len(block.rows)):
            seen.append([block.text(i, i + 1).decode() for i in range(block.first[d], block.first[d + 1])])
        for i, h in enumerate(block.hash.tolist()):
            assert hashes.setdefault(h, block.text(i, i + 1)) == block.text(i, i + 1)
        key, at = block.windows(3)
        for h, i in zip(key.tolist(), at.tolist()):
            assert block.doc[i] == block.doc[i + 2]
            assert hashes.setdefault(("w", h), block.text(i, i + 3)) == block.text(i, i + 3)
    assert seen == [words(t, lower) for t in texts]
    assert len({v for k, v in hashes.items() if not isinstance(k, tuple)}) == sum(not isinstance(k, tuple) for k in hashes)


def test_lower_is_ascii_only():
    (block,) = word_blocks(pa.array(["ÀB"]), True)
    assert block.text(0, 1).decode() == "ÀB".translate(LOWER) == "Àb"


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_offsets(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3 != 0).cast("int").alias("g"), F.when(F.col("id") % 7 == 0, None).otherwise(F.lit("x")).alias("h"), F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 5).alias("n"))
    got = running_offsets(rows, ["g", "h"], "k", ["k"], "n", rows_per_bucket=20).collect()
    assert len(got) == 500
    sums = {}
    for r in sorted(got, key=lambda r: r["k"]):
        group = (r["g"], r["h"])
        assert r["before"] == sums.get(group, 0)
        sums[group] = r["before"] + r["n"]


def test_shuffles_of_saved_rows_are_deleted(spark):
    """Also of rows that were defined before; the setting is as it was afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    newest = lambda: max([int(f.rpartition("/")[2].split("_")[1]) for f in glob.glob(f"{folder}/*/shuffle_*.data")], default=-1)
    rows = spark.range(5000).groupBy((F.col("id") % 50).alias("g")).count().repartition(3, "g")
    start = spark.sparkContext._jsc.sc().newShuffleId()
    kept = saved(rows)
    with stored(rows):
        pass
    for _ in range(50):
        if newest() <= start:
            break
        time.sleep(0.1)
    assert newest() <= start < spark.sparkContext._jsc.sc().newShuffleId() - 1
    assert kept.count() == 50 and spark.conf.get(name) == before


def test_temporaries_are_deleted(spark):
    folder = shared_dir(spark).removeprefix("file:")
    files = lambda: set(glob.glob(f"{folder}/*/rdd-*") + glob.glob(f"{folder}/rdd-*"))
    start = files()
    with temporaries() as keep:
        lost = saved(spark.range(10))
        with temporaries() as inner:
            saved(spark.range(11))
            outer, given = inner(saved(spark.range(12))), inner(saved(spark.range(13)))
        assert len(files() - start) == 3 and outer.count() == 12
        given = keep(given)
    assert len(files() - start) == 1 and given.count() == 13
    with pytest.raises(Exception):
        lost.count()
    discard(given)
    assert files() == start
    with pytest.raises(ZeroDivisionError):
        with temporaries():
            saved(spark.range(5))
            1 / 0
    assert files() == start and saved(spark.range(6)).count() == 6
