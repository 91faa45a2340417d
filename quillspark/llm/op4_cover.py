"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length 1, where cosine >= t is a distance of at most sqrt(2 - 2t). They are dealt to groups around
pivots and each group gets a cover tree: nested levels whose centres lie further apart than the level's radius, radii
halving, every node with the largest distance to what lies below it. A pair of nodes is dropped when their distance less
both covering radii exceeds the threshold, counted whole when it plus both radii is within, and opened otherwise. A pair
of groups is one task, so no task holds more than two groups, and links are counted, not listed: a task returns each
vector's number of links and a spanning forest of what it linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.graph import Forest, components
from quillspark.llm.store import Work, few, tune

COSINE = 0.9
#: Most vectors of a group, about; bytes of the vectors that are sampled for pivots; most pivots.
GROUP, SAMPLE, PIVOTS = 4096, 4 << 20, 256
#: Radii of the levels below the root. A wider first level would prune nothing: its reach exceeds most distances.
RADII = (0.5, 0.25, 0.125)
#: Widens and narrows bounds so that rounding can't drop or admit a pair; such pairs are decided on their cosine.
EPS = 1e-9
#: Squared lengths outside these bounds are taken of vectors scaled by their largest component, so that none over- or underflows.
PLAIN = (1e-200, 1e200)


def single(dim: int) -> float:
    """More than single precision can be off in a cosine of unit vectors: twice the bound for a sum of so many products."""
    return (dim + 8) * 2.0**-23


def unit(raw: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        square = (raw * raw).sum(1)
    far = ~((square > PLAIN[0]) & (square < PLAIN[1]))
    if far.any():
        raw = raw.copy()
        raw[far] /= np.abs(raw[far]).max(1)[:, None]
        square = (raw * raw).sum(1)
    return raw / np.sqrt(square)[:, None]


def usable(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which vectors are neither null nor zero and hold finite numbers only, and their numbers' bytes (null for the others)."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float) + 0.0  # null: NaN; minus zero: zero
    at = np.concatenate(([0], np.cumsum(size)))
    count = lambda hit: (lambda run: run[at[1:]] - run[at[:-1]])(np.concatenate(([0], np.cumsum(hit))))
    ok = (size > 0) & (count(np.isfinite(flat)) == size) & (count(flat != 0) > 0)
    data = flat.tobytes()
    return ok, pa.array([data[8 * a : 8 * z] if k else None for a, z, k in zip(at.tolist(), at[1:].tolist(), ok.tolist())], pa.binary())


def _cover(x: np.ndarray, centres: np.ndarray, best: np.ndarray, near: np.ndarray) -> None:
    """Brings every row's nearest centre, and the cosine to it, up to date with new centres."""
    n = np.arange(len(x))
    for k in range(0, len(centres), 512):
        s = x @ x[centres[k : k + 512]].T
        top = s.argmax(1)
        value = s[n, top]
        better = value > best
        best[better], near[better] = value[better], centres[k : k + 512][top[better]]
    near[centres] = centres


def _net(x: np.ndarray, centres: np.ndarray, r: float, best: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The centres and more of the rows, so that every row is within r of one and new ones are further apart."""
    need, out, i = 1 - r * r / 2, [centres], 0
    while len(open_ := np.flatnonzero(best[i:] < need)[:512] + i):
        s = x[open_] @ x[open_].T < need
        free, chosen = np.ones(len(open_), bool), []
        for k in range(len(open_)):
            if free[k]:
                chosen.append(k)
                free &= s[k]
        out.append(open_[chosen])
        _cover(x, out[-1], best, near)
        i = int(open_[-1]) + 1
    return np.concatenate(out)


class Tree:
    """Nodes of all levels: where they point among the rows, covering radius, rows below (a slice of `order`), children."""

    @staticmethod
    def nets(x: np.ndarray) -> np.ndarray:
        """Of each row its centre at each level, the root's first."""
        parent = np.zeros((len(RADII) + 1, len(x)), np.int64)
        centres = np.zeros(1, np.int64)
        best, near = np.full(len(x), -2.0), np.zeros(len(x), np.int64)
        _cover(x, centres, best, near)
        for level, r in enumerate(RADII, 1):
            centres = _net(x, centres, r, best, near)
            parent[level] = near
        return parent

    def __init__(self, x: np.ndarray, parent: np.ndarray) -> None:
        self.x, self.small, self.off = x, x.astype(np.float32), single(x.shape[1])
        n = len(x)
        self.levels = len(RADII) + 1
        # order the rows so that each node's rows are a slice; the rows themselves are the lowest level
        self.order = np.lexsort(parent[::-1])
        p = parent[:, self.order]
        self.start, self.stop, self.at, self.radius = [], [], [], []
        change = np.zeros(n, bool)
        for level in range(self.levels):
            change[1:] |= p[level, 1:] != p[level, :-1]
            start = np.concatenate(([0], np.flatnonzero(change)))
            stop = np.append(start[1:], n)
            c = np.where(stop - start > 1, p[level, start], self.order[start])
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[self.order], x[p[level]])))
            self.start.append(start)
            self.stop.append(stop)
            self.at.append(c)
            self.radius.append(np.where(stop - start > 1, np.maximum.reduceat(d, start) + EPS, 0.0))
        self.start.append(np.arange(n))
        self.stop.append(np.arange(1, n + 1))
        self.at.append(self.order)
        self.radius.append(np.zeros(n))
        self.first = [np.searchsorted(self.start[k + 1], self.start[k]) for k in range(self.levels)]
        self.last = [np.searchsorted(self.start[k + 1], self.stop[k]) for k in range(self.levels)]


def dual(a: Tree, b: Tree, same: bool, cosine: float, wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of a with rows of b and the reverse, and a spanning forest (rows of b count from len(a) on).

    wa, wb: how many vectors each row stands for.
    """
    near = math.sqrt(2 - 2 * cosine)
    na, nb = len(a.x), len(b.x)
    la, lb = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    shift = 0 if same else na
    forest = Forest(na + (0 if same else nb))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def children(t: Tree, level: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = t.last[level][k] - t.first[level][k]
        return n, t.first[level][k]

    for level in range(a.levels):
        keep_i, keep_j = [], []
        n_i, f_i = children(a, level, i)
        n_j, f_j = children(b, level, j)
        size, at = n_i * n_j, 0
        final = level + 1 == a.levels
        while at < len(i):
            if size[at] > 100_000:  # one dense block
                ca, cb = np.arange(f_i[at], f_i[at] + n_i[at]), np.arange(f_j[at], f_j[at] + n_j[at])
                parts = [(ca[:0], cb[:0], np.empty(0))]
                pa_, pb = a.at[level + 1][ca], b.at[level + 1][cb]
                xa, xb, ra, rb = a.small[pa_], b.small[pb], a.radius[level + 1][ca], b.radius[level + 1][cb]
                for mine in (rb == 0, rb > 0):  # a bound for each row and kind of node, in single precision; then the exact one
                    if not mine.any():
                        continue
                    cols, most = np.flatnonzero(mine), rb[mine].max()
                    right = np.ascontiguousarray(xb[cols].T)
                    for k in range(0, len(ca), 512):
                        bound = (1 - (near + EPS + ra[k : k + 512] + most) ** 2 / 2 - a.off).astype(np.float32)
                        hit = np.flatnonzero((xa[k : k + 512] @ right >= bound[:, None]).ravel())
                        p, q = hit // len(cols) + k, cols[hit % len(cols)]
                        v = np.einsum("ij,ij->i", a.x[pa_[p]], b.x[pb[q]])
                        ok = 2 - 2 * v <= (near + EPS + ra[p] + rb[q]) ** 2
                        parts.append((ca[p[ok]], cb[q[ok]], v[ok]))
                to = at + 1
                ci, cj, s = (np.concatenate(x) for x in zip(*parts))
            else:  # many small ones, written out
                to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 400_000, "right")) + at)
                big = np.flatnonzero(size[at:to] > 100_000)
                to = at + int(big[0]) if len(big) else to
                m = size[at:to]
                within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                row = np.repeat(np.arange(at, to), m)
                ci, cj = f_i[row] + within // n_j[row], f_j[row] + within % n_j[row]
                s = np.einsum("ij,ij->i", a.x[a.at[level + 1][ci]], b.x[b.at[level + 1][cj]])
                reach = near + EPS + a.radius[level + 1][ci] + b.radius[level + 1][cj]
                ok = 2 - 2 * s <= reach * reach
                ci, cj, s = ci[ok], cj[ok], s[ok]
            at = to
            if same:
                ok = ci <= cj
                ci, cj, s = ci[ok], cj[ok], s[ok]
            if final:
                ra, rb = a.at[level + 1][ci], b.at[level + 1][cj]
                ok = (s >= cosine) & ((ra != rb) if same else True)
                ra, rb = ra[ok], rb[ok]
                np.add.at(la, ra, wb[rb])
                np.add.at(lb, rb, wa[ra])
                forest.join(np.stack((ra, rb + shift)))
                continue
            # pairs of nodes all of whose rows are linked: counted whole
            ra, rb = a.radius[level + 1][ci], b.radius[level + 1][cj]
            inside = np.sqrt(np.maximum(0, 2 - 2 * s)) + ra + rb + EPS <= near
            inside &= ~((ci == cj) if same else np.zeros(len(ci), bool))
            for x, y in zip(ci[inside], cj[inside]):
                rows_a = a.order[a.start[level + 1][x] : a.stop[level + 1][x]]
                rows_b = b.order[b.start[level + 1][y] : b.stop[level + 1][y]]
                la[rows_a] += wb[rows_b].sum()
                lb[rows_b] += wa[rows_a].sum()
                forest.join(np.stack((np.append(rows_a, np.full(len(rows_b), rows_a[0])), np.append(np.full(len(rows_a), rows_b[0]), rows_b) + shift)))
            keep_i.append(ci[~inside])
            keep_j.append(cj[~inside])
        if not final:
            i, j = np.concatenate(keep_i or [i[:0]]), np.concatenate(keep_j or [j[:0]])
    if same:
        la += lb
    return la, lb, forest.edges


def pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first centres, until all of the sample is within the first radius of one."""
    out, best = [0], sample @ sample[0]
    while len(out) < min(most, len(sample)) and best.min() < 1 - RADII[0] ** 2 / 2:
        out.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[out[-1]])
    return sample[out]


def chain(centre: np.ndarray, cells: list[int]) -> list[int]:
    """The cells in an order in which each is followed by the nearest of those left, so that neighbours share groups."""
    out, left = cells[:1], cells[1:]
    while left:
        k = int((centre[left] @ centre[out[-1]]).argmax())
        out.append(left.pop(k))
    return out


def near_vectors(rows: DataFrame, cosine: float = COSINE, group: int = GROUP) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, for rows with vec_id and embedding.

    Vectors that are null, zero or hold null or non-finite numbers link with nothing. Equal vectors are one point with a
    count. Vectors of different lengths (dimensions) are compared among their own length only. Rows that share a vec_id
    are vectors of their own that share a name. Null vec_id: returned unlinked, kept.
    """
    spark = rows.sparkSession
    tune(spark)
    work = Work(spark, "cover")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["vec_id"], usable(b["v"])[1]], ["vec_id", "raw"])

    named = work.put(rows.mapInArrow(check, "vec_id long, raw binary"))
    points = work.put(named.where("raw is not null and vec_id is not null").groupBy("raw").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    bytes_ = F.octet_length("raw")
    sizes = work.put(points.groupBy(bytes_.alias("b")).agg(F.count("*").alias("n")))
    links, edges = None, None

    def add(done: DataFrame) -> None:
        nonlocal links, edges
        some_links = done.where("other is null").select("node", "n")
        some_edges = done.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
        links, edges = (some_links, some_edges) if links is None else (links.unionByName(some_links), edges.unionByName(some_edges))

    def alone(t: pa.Table) -> pa.Table:
        """Links within all vectors of one length, of which there are no more than a group's."""
        x = unit(np.frombuffer(b"".join(t["raw"].to_pylist())).reshape(t.num_rows, -1))
        tree = Tree(x, Tree.nets(x))
        node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        n, _, pairs = dual(tree, tree, True, cosine, copies, copies)
        keep = n > 0
        a, b = (node[[p[k] for p in pairs]] if pairs else np.empty(0, np.int64) for k in (0, 1))
        return pa.table({"node": pa.array(np.concatenate((node[keep], a))), "other": pa.array([None] * int(keep.sum()) + b.tolist(), pa.int64()), "n": pa.array(np.concatenate((n[keep], np.zeros(len(a), np.int64))))})

    few_of = points.join(sizes.where(F.col("n") <= group).select("b").hint("shuffle_hash"), bytes_ == F.col("b"), "left_semi")
    dims = [r[0] // 8 for r in sizes.where(F.col("n") > group).select("b").collect()]  # one in `group` vectors at most
    if sizes.where(F.col("n") <= group).limit(1).count():
        add(work.put(few_of.withColumn("b", bytes_).groupBy("b").applyInArrow(alone, "node long, other long, n long")))
    for dim in sorted(dims):
        mine = points.where(F.octet_length("raw") == 8 * dim)
        some = mine.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(max(64, SAMPLE // (8 * dim))).collect()
        centre = pivots(unit(np.frombuffer(b"".join(bytes(r[0]) for r in some)).reshape(-1, dim)))

        def deal(batches: Iterator[pa.RecordBatch], dim: int = dim, centre: np.ndarray = centre) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = unit(np.frombuffer(b"".join(b["raw"].to_pylist())).reshape(-1, dim))
                    s = x @ centre.T
                    k = s.argmax(1)
                    d = np.sqrt(np.maximum(0, 2 - 2 * s[np.arange(len(k)), k]))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k.astype(np.int32)), pa.array(d)], [*b.schema.names, "cell", "far"])

        dealt = work.put(mine.mapInArrow(deal, "raw binary, node long, copies long, cell int, far double"))
        cells = {r[0]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most PIVOTS rows
        # small cells share a group, large ones are split by hash; a group's bound is that of the cells in it
        ranges, groups, room = {}, [], 0
        for c in chain(centre, sorted(cells)):
            parts = -(-cells[c].n // group)
            if parts == 1 and room >= cells[c].n:
                groups[-1].append(c)
                room -= cells[c].n
                ranges[c] = (len(groups) - 1, 1)
            else:
                ranges[c] = (len(groups), parts)
                groups += [[c] for _ in range(parts)]
                room = group - cells[c].n if parts == 1 else 0
        near = math.sqrt(2 - 2 * cosine)
        gap = np.sqrt(np.maximum(0, 2 - 2 * centre @ centre.T))

        def apart(g: int, h: int) -> bool:
            return all(gap[x, y] > near + EPS + cells[x].far + cells[y].far for x in groups[g] for y in groups[h])

        m = len(groups)
        tiles = [(g, h) for g in range(m) for h in range(g, m) if not apart(g, h)]
        number = {t: k for k, t in enumerate(tiles)}
        of_group = [[(number[t], 2 if t[0] == t[1] else int(t[1] == g)) for t in ([(min(g, h), max(g, h)) for h in range(m)]) if t in number] for g in range(m)]

        def number_groups(batches: Iterator[pa.RecordBatch], ranges: dict = ranges) -> Iterator[pa.RecordBatch]:
            for b in batches:
                grp = [ranges[c][0] + (n * 0x9E3779B1 >> 8) % ranges[c][1] for c, n in zip(b["cell"].to_pylist(), b["node"].to_pylist())]
                yield pa.RecordBatch.from_arrays([b["node"], b["copies"], b["raw"], pa.array(grp, pa.int32())], ["node", "copies", "raw", "grp"])

        def send(batches: Iterator[pa.RecordBatch], of_group: list = of_group) -> Iterator[pa.RecordBatch]:
            names = ["node", "copies", "raw", "place", "nets"]
            for b in batches:
                to = [(i, t, s) for i, g in enumerate(b["grp"].to_pylist()) for t, s in of_group[g]]
                for k in range(0, len(to), 4096):
                    row, tile, side = zip(*to[k : k + 4096])
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), pa.array(side, pa.int32()), *(b[c].take(at) for c in names)], ["tile", "side", *names])

        def match(t: pa.Table) -> pa.Table:
            t = t.take(np.lexsort((t["place"].to_numpy(), t["side"].to_numpy())))
            side = t["side"].to_numpy()
            nets = np.frombuffer(b"".join(t["nets"].to_pylist()), "<i4").reshape(-1, len(RADII) + 1).T.astype(np.int64)
            x = unit(np.frombuffer(b"".join(t["raw"].to_pylist())).reshape(-1, dim))
            node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
            same = bool((side == 2).all())  # a group with itself; else a side may have no rows
            rows_a, rows_b = np.flatnonzero(side == (2 if same else 0)), np.flatnonzero(side == (2 if same else 1))
            out_node, out_n, edges = np.empty(0, np.int64), np.empty(0, np.int64), []
            if len(rows_a) and len(rows_b):
                ta = Tree(x[rows_a], nets[:, rows_a])
                tb = ta if same else Tree(x[rows_b], nets[:, rows_b])
                la, lb, edges = dual(ta, tb, same, cosine, copies[rows_a], copies[rows_b])
                out_node = np.concatenate((node[rows_a], [] if same else node[rows_b])).astype(np.int64)
                out_n = np.concatenate((la, [] if same else lb)).astype(np.int64)
            ids = np.concatenate((node[rows_a], [] if same else node[rows_b])).astype(np.int64)
            other = [None] * len(out_node) + [int(ids[b]) for _, b in edges]
            keep = out_n > 0
            return pa.table({"node": pa.array(np.concatenate((out_node[keep], ids[[a for a, _ in edges]] if edges else np.empty(0, np.int64)))), "other": pa.array([None] * int(keep.sum()) + other[len(out_node) :], pa.int64()), "n": pa.array(np.concatenate((out_n[keep], np.zeros(len(edges), np.int64))))})

        def build(t: pa.Table) -> pa.Table:
            x = unit(np.frombuffer(b"".join(t["raw"].to_pylist())).reshape(-1, dim))
            parent = np.ascontiguousarray(Tree.nets(x).T.astype("<i4"))
            return pa.table({"node": t["node"], "copies": t["copies"], "raw": t["raw"], "place": pa.array(np.arange(len(x), dtype=np.int32)), "nets": pa.array([p.tobytes() for p in parent], pa.binary()), "grp": t["grp"]})

        grouped = dealt.drop("far").mapInArrow(number_groups, "node long, copies long, raw binary, grp int")
        built = work.put(grouped.groupBy("grp").applyInArrow(build, "node long, copies long, raw binary, place int, nets binary, grp int"))
        sent = built.mapInArrow(send, "tile int, side int, node long, copies long, raw binary, place int, nets binary")
        add(work.put(sent.groupBy("tile").applyInArrow(match, "node long, other long, n long")))
    out = named.join(points.select("raw", "node", "copies"), "raw", "left")
    if links is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = components(edges, work)
    summed = links.groupBy("node").agg(F.sum("n").alias("n"))
    out = out.join(summed, "node", "left").join(comp, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("vec_id").isNull() | F.col("raw").isNull(), F.col("vec_id")).otherwise(F.coalesce("comp", "node")))
    return few(out.select("vec_id", F.expr("if(raw is null or vec_id is null, 0L, coalesce(n, 0L) + copies - 1)").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)),
u AS (SELECT vec_id, list_transform(e, lambda x: x / norm) AS e FROM g WHERE norm > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, m.vec_id = component_id AS kept FROM embeddings m JOIN c ON c.node = m.vec_id"""
