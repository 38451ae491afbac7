"""Exact near-duplicate embeddings by dual traversal of cover trees (operator 6).

On the unit sphere a cosine of c is a distance of sqrt(2 - 2c), for which the triangle inequality
holds.  A shared top level of centres, fitted on a bounded sample, cuts the vectors into cells with exact covering
radii; each block of a cell has a cover tree: nested levels whose radii halve, where the centres of a level are further apart than
its radius and every row is within it of one of them.  Pairs of
cells, then of nodes, are dropped where the distance of their centres less both covering radii is above the
threshold, are linked as a whole where that distance plus both radii is below it, and are opened otherwise; single
vectors, and nodes of the finest level, are compared vector by vector.  What leaves a task are counts of links and the edges of a
spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, saved, temporaries

#: Vectors of a block, and blocks of one side of a task.
BLOCK, SIDE = 4096, 8
#: Slack for rounding in bounds; a cosine this close to the threshold is computed again exactly.
SLACK, CLOSE = 1e-7, 1e-12
#: Nodes of one side whose distances to the other side's are computed at a time; pairs of nodes from which on that is a product of matrices.
TILE, MANY = 1024, 8192


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


@dataclass
class Tree:
    """A cover tree over the rows of a matrix, put in an order in which a node's rows are a range.

    ``order`` has the rows' first places.  Of each node: its range, the place of its centre, its covering radius, the radius of its level, and
    its children, which stand together.  A centre is its own child on the levels below; where it is the only one the levels are one node.
    """

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    level: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def dump(self) -> bytes:
        parts = [self.order, self.begin, self.end, self.centre, self.first, self.count]
        head = np.array([len(self.order), len(self.begin)], np.int64)
        return b"".join(x.astype(np.int64).tobytes() for x in (head, *parts)) + self.radius.tobytes() + self.level.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        n, nodes = np.frombuffer(blob, np.int64, 2).tolist()
        order, begin, end, centre, first, count = np.split(np.frombuffer(blob, np.int64, n + 5 * nodes, 16), n + nodes * np.arange(5))
        radius, level = np.frombuffer(blob, np.float64, 2 * nodes, 16 + 8 * (n + 5 * nodes)).reshape(2, -1)
        return cls(order, begin, end, centre, radius, level, first, count)


def build(x: np.ndarray, finest: float = 0.05, top: float = 2.0) -> Tree:
    """The tree of unit vectors, with levels of radius top, top / 2 and so on down to ``finest``, if rows are that far apart.

    A level starts with the centres of the one above; rows that none of them covers become centres in turn.  A new centre's parent is the
    nearest centre of the level above, and a row belongs to the nearest centre of the finest level.
    """
    n = len(x)
    gaps = distances(x @ x.T)
    near, owner = gaps[0].copy(), np.zeros(n, np.int64)
    radii, parents, radius = [top], [], top
    while radius > finest and near.max() > 0:
        radius /= 2
        above, at = owner.copy(), 0
        parent = np.arange(n)
        while at < n:
            at += int((near[at:] > radius).argmax())
            if near[at] <= radius:
                break
            parent[at] = above[at]
            closer = gaps[at] < near
            near[closer] = gaps[at][closer]
            owner[closer] = at
        radii.append(radius)
        parents.append(parent)
    paths = [owner]
    for parent in parents[::-1]:
        paths.append(parent[paths[-1]])
    paths.reverse()
    order = np.lexsort([np.arange(n), *paths[::-1]])
    paths = [p[order] for p in paths]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # where a node of a level starts; paths of coarser levels change there too
    new, cuts = np.zeros(n, bool), []
    for p in paths:
        new = new | np.concatenate([[True], p[1:] != p[:-1]])
        cuts.append(np.flatnonzero(new))
    nodes: list[list[float]] = []

    def node(lo: int, hi: int, level: int) -> None:
        centre = int(paths[level][lo])
        reach = float(gaps[centre][order[lo:hi]].max()) if hi - lo > 1 else 0.0
        nodes.append([lo, hi, int(place[centre]), reach, radii[level], 0, 0])

    node(0, n, 0)
    stack = [(0, 0)]
    while stack:
        at, level = stack.pop()
        lo, hi = nodes[at][:2]
        while hi - lo > 1 and level + 1 < len(cuts):
            level += 1
            inside = cuts[level][np.searchsorted(cuts[level], lo) : np.searchsorted(cuts[level], hi)].tolist()
            if len(inside) > 1:
                nodes[at][5:] = [len(nodes), len(inside)]
                for a, b in zip(inside, [*inside[1:], hi]):
                    if b - a > 1:
                        stack.append((len(nodes), level))
                    node(a, b, level)
                break
    columns = list(zip(*nodes))
    whole = [np.array(columns[i], np.int64) for i in (0, 1, 2, 5, 6)]
    return Tree(order, *whole[:3], np.array(columns[3]), np.array(columns[4]), *whole[3:])


@dataclass
class Block:
    """Vectors of a block in the order of its tree, from ``start`` on among the rows of a task."""

    start: int
    raw: np.ndarray
    weight: np.ndarray
    tree: Tree
    x: np.ndarray = field(init=False)

    def __post_init__(self):
        self.x = unit(self.raw)
        self.total = np.concatenate([[0], np.cumsum(self.weight)])
        self.chained = np.zeros(len(self.tree.begin), bool)

    def weights(self, nodes: np.ndarray) -> np.ndarray:
        return self.total[self.tree.end[nodes]] - self.total[self.tree.begin[nodes]]

    def chains(self, nodes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Edges between all rows of each node, where they weren't asked for before."""
        new = np.unique(nodes[~self.chained[nodes]])
        self.chained[new] = True
        found = [np.arange(self.tree.begin[i], self.tree.end[i]) for i in new[self.tree.end[new] - self.tree.begin[new] > 1]]
        return [(self.start + rows[1:], self.start + rows[:-1]) for rows in found]


class Links:
    """Counts of links, and components by a forest over places."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unites each a with its b."""
        while len(a):
            x, y = self.label[a], self.label[b]
            move = x != y
            a, b, x, y = a[move], b[move], x[move], y[move]
            if not len(a):
                return
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = to[to]
                if (further == to).all():
                    break
                to = further
            self.label = to[self.label]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.astype(np.float64).tolist(), b.astype(np.float64).tolist()
    dot = math.fsum(p * q for p, q in zip(a, b))
    return dot / math.sqrt(math.fsum(p * p for p in a) * math.fsum(q * q for q in b))


@dataclass
class Visits:
    """What a traversal did: pairs of nodes that were looked at, dropped, and linked as a whole; pairs of vectors compared in matrices."""

    seen: int = 0
    dropped: int = 0
    whole: int = 0
    compared: int = 0


def dual(links: Links, one: Block, two: Block, least: float) -> Visits:
    """Adds the links between the rows of two blocks, or of one with itself, to those of a task."""
    same, visits = one is two, Visits()
    limit = math.sqrt(max(0.0, 2 - 2 * least))
    a, b = one.tree, two.tree
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    todo: list[tuple[np.ndarray, np.ndarray]] = []

    def near(u: np.ndarray, v: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Which pairs of nodes aren't dropped; of a node with itself, or its own children, each pair counts once."""
        # the distance is at most this where the cosine is at least 1 - reach ** 2 / 2
        reach = (a.radius[u] + (limit + SLACK)) + b.radius[v]
        reach *= reach
        reach *= -0.5
        reach += 1.0
        open_ = cosine >= reach
        visits.seen += open_.size
        visits.dropped += open_.size - int(open_.sum())
        return open_

    def settle(u: np.ndarray, v: np.ndarray, cosine: np.ndarray) -> None:
        """Links what is settled by bounds or by being two vectors, and leaves the rest to be opened."""
        spread = a.radius[u] + b.radius[v]
        whole = distances(cosine) + spread < limit - SLACK
        points = (a.end[u] - a.begin[u] == 1) & (b.end[v] - b.begin[v] == 1)
        visits.whole += int(whole.sum())
        for k in np.flatnonzero(points & ~whole & (np.abs(cosine - least) < CLOSE)):
            cosine[k] = exact_cosine(one.raw[a.begin[u[k]]], two.raw[b.begin[v[k]]])
        linked = whole | (points & (cosine >= least))
        if linked.any():
            _count(links, one, two, u[linked], v[linked], same)
            ends.append((one.start + a.begin[u[linked]], two.start + b.begin[v[linked]]))
            for block, nodes in ((one, u[linked]), (two, v[linked])):
                ends.extend(block.chains(nodes))
        left = ~whole & ~points
        bare = left & (a.count[u] == 0) & (b.count[v] == 0)
        for i, j in zip(u[bare].tolist(), v[bare].tolist()):
            visits.compared += int((a.end[i] - a.begin[i]) * (b.end[j] - b.begin[j]))
            _compare(links, one, two, i, j, least, same and i == j)
        left &= ~bare
        if left.any():
            todo.append((u[left], v[left]))

    root = np.zeros(1, np.int64)
    cosine = np.array([one.x[a.centre[0]] @ two.x[b.centre[0]]])
    if near(root, root, cosine)[0]:
        settle(root, root, cosine)
    while todo:
        u, v = todo.pop()
        wide, deep = np.maximum(a.count[u], 1), np.maximum(b.count[v], 1)
        low = np.where(a.count[u] > 0, a.first[u], u), np.where(b.count[v] > 0, b.first[v], v)
        size = wide * deep
        for k in np.flatnonzero(size > MANY):
            other = low[1][k] + np.arange(deep[k])
            for lo in range(0, int(wide[k]), TILE):
                mine = low[0][k] + np.arange(lo, min(lo + TILE, int(wide[k])))
                cosine = one.x[a.centre[mine]] @ two.x[b.centre[other]].T
                open_ = near(mine[:, None], other[None, :], cosine)
                if same and u[k] == v[k]:
                    open_ &= mine[:, None] <= other[None, :]
                p, q = np.nonzero(open_)
                settle(mine[p], other[q], cosine[p, q])
        few = np.flatnonzero(size <= MANY)
        cuts = np.searchsorted(np.cumsum(size[few]), MANY * np.arange(1, 1 + int(size[few].sum()) // MANY))
        for part in np.split(few, cuts):
            if not len(part):
                continue
            at = np.repeat(part, size[part])
            nth = np.arange(len(at)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            mine, other = low[0][at] + nth // deep[at], low[1][at] + nth % deep[at]
            if same:
                once = (u[at] != v[at]) | (mine <= other)
                mine, other = mine[once], other[once]
            cosine = np.einsum("ij,ij->i", one.x[a.centre[mine]], two.x[b.centre[other]])
            open_ = near(mine, other, cosine)
            settle(mine[open_], other[open_], cosine[open_])
    if ends:
        links.join(*map(np.concatenate, zip(*ends)))
    return visits


def _count(links: Links, one: Block, two: Block, u: np.ndarray, v: np.ndarray, same: bool) -> None:
    """Counts the links of all rows of each node u with all of its node v, and the other way round; a node's with itself once."""
    for block, nodes, weight in ((one, u, two.weights(v)), (two, v, np.where(same & (u == v), 0, one.weights(u)))):
        edge = np.zeros(len(block.x) + 1, np.int64)
        np.add.at(edge, block.tree.begin[nodes], weight)
        np.add.at(edge, block.tree.end[nodes], -weight)
        links.count[block.start : block.start + len(block.x)] += np.cumsum(edge)[:-1]


def _compare(links: Links, one: Block, two: Block, i: int, j: int, least: float, mirror: bool, tile: int = 512) -> None:
    """Links the rows of two nodes that are similar; of a node with itself if ``mirror``."""
    a, b, c, d = one.tree.begin[i], one.tree.end[i], two.tree.begin[j], two.tree.end[j]
    for lo in range(a, b, tile):
        hi = min(b, lo + tile)
        cosine = one.x[lo:hi] @ two.x[c:d].T
        near = cosine >= least
        for p, q in zip(*np.nonzero(np.abs(cosine - least) < CLOSE)):
            near[p, q] = exact_cosine(one.raw[lo + p], two.raw[c + q]) >= least
        if not near.any():
            continue
        links.count[one.start + lo : one.start + hi] += near @ two.weight[c:d]
        if not mirror:
            links.count[two.start + c : two.start + d] += one.weight[lo:hi] @ near
        # a spanning forest: rows and columns take turns in passing on the smallest row that reaches them
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        sub = near[np.ix_(rows, columns)]
        reach = np.arange(len(rows))
        while True:
            column = np.where(sub, reach[:, None], len(rows)).min(axis=0)
            new = np.minimum(reach, np.where(sub, column[None, :], len(rows)).min(axis=1))
            if (new == reach).all():
                break
            reach = new
        links.join(one.start + lo + rows, one.start + lo + rows[reach])
        links.join(two.start + c + columns, one.start + lo + rows[column])


def _matrix(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.float32 if n > 0 else np.float64).reshape(abs(n), -1)


def _valid(column: pa.Array) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for v in column:
        value = v.as_py()
        if value is None or not value or any(p is None for p in value):
            out.append(None)
            continue
        x = np.array(value, np.float64) + 0.0
        with np.errstate(over="ignore"):
            good = np.isfinite(x).all() and 0 < float(x @ x) < math.inf
        out.append(x if good else None)
    return out


def vectors(rows: DataFrame) -> DataFrame:
    """(id, dim, v) of the rows of (id, embedding) that can link: the components as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _valid(batch.column(1))
            keep = [i for i, x in enumerate(found) if x is not None]
            blobs = [found[i].tobytes() for i in keep]
            dims = [len(found[i]) for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["id", "dim", "v"])

    return rows.where("id is not null").select("id", "embedding").mapInArrow(lean(run), "id long, dim int, v binary")


def _double(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.float64)


def near_duplicates(table: DataFrame, least: float = 0.95, block: int = BLOCK, max_sample: int = 4096, side: int = SIDE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding).

    Two rows link when the cosine of their vectors, of one length, is ``least`` or more.  A vector that is null, empty
    or zero, or that holds a null or a non-finite component, links with nothing and is its own component; so
    does a row with a null vec_id, whose component is null and which isn't kept.  Equal
    vectors are compared once and count each; repeated rows link with each other.  Rows of one vec_id are in one
    component.  An empty table gives an empty result; other columns are not read.  The top level's
    centres are from the ``max_sample`` vectors of the smallest hash of vec_id, one for each ``block`` vectors of the table; all else
    covers every row.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("id"), "embedding")
    with temporaries() as keep:
        every = saved(vectors(rows))
        classes = saved(every.groupBy("dim", "v").agg(F.min("id").alias("id"), F.count("*").alias("w")))
        total = classes.count()
        digest = F.xxhash64("id")
        # far more than the sample fall below this part of the hashes, so that the sort for it stays small
        part = min(1 << 32, (4 * max_sample << 32) // max(1, total))
        low = classes.where(F.call_function("shiftrightunsigned", digest, F.lit(32)) < F.lit(part))
        sample = low.orderBy(digest, "id").limit(max_sample).select("dim", "v").collect()
        cells = max(1, total // block)
        centres: dict[int, np.ndarray] = {}
        for dim in sorted({r[0] for r in sample}):
            x = unit(np.stack([_double(r[1]) for r in sample if r[0] == dim]))
            # the farthest row is the next centre, so that every prefix is a level of its own radius
            chosen, far = [0], np.full(len(x), np.inf)
            while len(chosen) < min(cells, len(x)):
                far = np.minimum(far, 2 - 2 * (x @ x[chosen[-1]]))
                if far.max() <= 1e-12:
                    break
                chosen.append(int(far.argmax()))
            centres[dim] = x[chosen]
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = shared.value
            for batch in batches:
                dims, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                cell, gap = np.full(len(dims), -1, np.int64), np.full(len(dims), 4.0)
                for dim in set(dims) & set(top):
                    at = np.array([i for i, n in enumerate(dims) if n == dim])
                    x = unit(np.stack([_double(blobs[i]) for i in at]))
                    cosine = x @ top[dim].T
                    cell[at] = cosine.argmax(axis=1)
                    gap[at] = np.linalg.norm(x - top[dim][cell[at]], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], ["dim", "v", "id", "w", "cell", "gap"])

        placed = saved(classes.mapInArrow(lean(assign), "dim int, v binary, id long, w long, cell long, gap double"))
        parts = F.ceil(F.count("*") / block).alias("parts")
        cover = placed.groupBy("dim", "cell").agg(F.max("gap").alias("r"), parts)
        # cells of dimensions that the sample lacks have no centre; there may be many such dimensions, each with one cell
        known = F.col("dim").isin([int(d) for d in centres]) if centres else F.lit(False)
        sizes: dict[int, list] = {}
        for r in cover.where(known).orderBy("dim", "cell").collect():
            sizes.setdefault(r["dim"], []).append((r["cell"], r["r"], r["parts"]))
        limit = math.sqrt(max(0.0, 2 - 2 * least))
        bases, near = [], []
        for dim, found in sizes.items():
            cell, radius, count = (np.array(x) for x in zip(*found))
            before = np.cumsum(count) - count
            bases += [(dim, *x) for x in zip(cell.tolist(), before.tolist())]
            first, last = before // side, (before + count - 1) // side
            for lo in range(0, len(cell), TILE):
                gap = distances(centres[dim][cell[lo : lo + TILE]] @ centres[dim][cell].T)
                # pairs of groups of blocks that hold cells that may be near
                i, j = np.nonzero(gap <= radius[lo : lo + TILE, None] + radius[None, :] + limit + SLACK)
                spans = np.unique(np.stack([first[lo + i], last[lo + i], first[j], last[j]]), axis=1)
                near.append(pa.table({"dim": np.full(spans.shape[1], dim, np.int32), "a0": spans[0], "a1": spans[1], "b0": spans[2], "b1": spans[3]}))
        lost = cover.where(~known).select("dim", "cell", F.lit(0).cast("long").alias("base"), "parts")
        based = spark.createDataFrame(bases, "dim int, cell long, base long").join(cover.select("dim", "cell", "parts"), ["dim", "cell"])
        chunks = placed.join(based.unionByName(lost), ["dim", "cell"])
        chunks = chunks.withColumn("at", F.col("base") + F.pmod(F.xxhash64("id", "v"), F.col("parts")))
        finest = limit / 4

        def pack(group: pa.Table) -> pa.Table:
            raw = np.stack([_double(b.as_py()) for b in group.column("v")])
            tree = build(unit(raw), finest)
            raw = raw[tree.order]
            small = raw.astype(np.float32)
            as_float = bool((small.astype(np.float64) == raw).all())
            n = len(raw)
            column = lambda name: group.column(name).to_numpy().astype(np.int64)[tree.order].tobytes()
            return pa.table(
                {
                    "dim": group.column("dim").slice(0, 1),
                    "at": group.column("at").slice(0, 1),
                    "n": pa.array([n if as_float else -n], pa.int64()),
                    "ids": pa.array([column("id")], pa.binary()),
                    "w": pa.array([column("w")], pa.binary()),
                    "raw": pa.array([(small if as_float else raw).tobytes()], pa.binary()),
                    "tree": pa.array([tree.dump()], pa.binary()),
                }
            )

        schema = "dim int, at long, n long, ids binary, w binary, raw binary, tree binary"
        blocks = saved(chunks.select("dim", "at", "id", "w", "v").groupBy("dim", "at").applyInArrow(pack, schema).withColumn("g", F.expr(f"at div {side}")))
        spans = spark.createDataFrame(pa.concat_tables(near)) if near else spark.createDataFrame([], "dim int, a0 long, a1 long, b0 long, b1 long")
        own = lost.select("dim", F.lit(0).cast("long").alias("a0"), F.expr(f"(parts - 1) div {side}").alias("a1"))
        spans = spans.union(own.select("dim", "a0", "a1", F.col("a0").alias("b0"), F.col("a1").alias("b1")))
        pairs = spans.select("dim", F.explode(F.sequence("a0", "a1")).alias("g1"), "b0", "b1").select("dim", "g1", F.explode(F.sequence("b0", "b1")).alias("g2"))
        pairs = pairs.where("g1 <= g2").distinct()
        ends = pairs.select("dim", "g1", "g2", F.explode(F.array_distinct(F.array("g1", "g2"))).alias("g"))

        def search(group: pa.Table) -> pa.Table:
            value = lambda name: [v.as_py() for v in group.column(name)]
            found, names, n = [], [], 0
            one, two = group.column("g1")[0].as_py(), group.column("g2")[0].as_py()
            for g, size, ids, w, raw, tree in sorted(zip(*map(value, ("g", "n", "ids", "w", "raw", "tree"))), key=lambda r: (r[0], r[2])):
                found.append((g, Block(n, _matrix(raw, size), np.frombuffer(w, np.int64), Tree.load(tree))))
                names.append(np.frombuffer(ids, np.int64))
                n += abs(size)
            links = Links(n)
            for i, (g, a) in enumerate(found):
                for h, b in found[i:]:
                    if (g, h) == (one, two):
                        dual(links, a, b, least)
            ids = np.concatenate(names)
            if one == two:
                links.count -= 1
            some = np.flatnonzero(links.count)
            edge = np.flatnonzero(links.label != np.arange(n))
            blank = np.concatenate([np.ones(len(some), bool), np.zeros(len(edge), bool)])
            y = pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[links.label[edge]]]), mask=blank)
            return pa.table({"x": pa.array(np.concatenate([ids[some], ids[edge]])), "y": y, "k": pa.array(np.concatenate([links.count[some], np.zeros(len(edge), np.int64)]))})

        dealt = ends.join(blocks, ["dim", "g"]).select("dim", "g1", "g2", "g", "n", "ids", "w", "raw", "tree")
        found = saved(dealt.groupBy("dim", "g1", "g2").applyInArrow(search, "x long, y long, k long"))
        counts = found.where("y is null").groupBy(F.col("x").alias("cls")).agg(F.sum("k").alias("k"))
        members = every.join(classes.select("dim", "v", F.col("id").alias("cls"), "w"), ["dim", "v"]).select("id", "cls", "w")
        members = keep(saved(members.join(counts, "cls", "left").select("id", "cls", F.coalesce("k", F.col("w") - 1).alias("k"))))
        edges = found.where("y is not null").select(F.col("x").alias("a"), F.col("y").alias("b"))
        component = keep(connected_components(edges.union(members.where("id <> cls").select(F.col("id").alias("a"), F.col("cls").alias("b")))))
        links = members.groupBy("id").agg(F.max("k").alias("k"))
        out = rows.select("id").join(links, "id", "left").join(component, F.col("id") == component["node"], "left")
        out = out.select(F.col("id").alias("vec_id"), F.coalesce("k", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
