"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are scaled to length one at most and given one more coordinate that makes it one (zero for queries),
so that the largest inner product is the smallest Euclidean distance. A table's hash is the floor of
``keys`` Gaussian projections over a bucket width. A query visits its own bucket and then perturbed ones, in
the order of estimated success: the sums of squared distances to the walls that a perturbation crosses.
Candidates of all tables are merged and reranked by the exact inner product of the original vectors.

Equal vectors are searched once: a class keeps its ids' first few, which is all that can ever be among the
nearest. Buckets meet their probes by shuffle, grouped by the leading hash values so that one copy of a
query serves many probes; a group with more vectors than one task should hold is salted, and queries go to
each part. Inside a task queries stream past the vectors in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle

#: Vectors that one part of a group holds at most, about; queries worked on at once.
PART, BLOCK = 20_000, 1_000


class Hashes:
    """Seeded hash tables over vectors of a dimension."""

    def __init__(self, dim: int, scale: float, tables: int, keys: int, width: float, lead: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dim + 1, keys))
        self.b = rng.uniform(0, width, (tables, keys))
        self.scale, self.width, self.tables, self.keys, self.lead = scale, width, tables, keys, lead

    def projected(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(tables, n, keys), in bucket widths."""
        if query:
            x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        else:
            x = x / self.scale
            x = np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True)))])
        return (np.einsum("nd,tdk->tnk", x, self.a) + self.b[:, None, :]) / self.width

    def code(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cell of each row, a few bits per key."""
        out = np.zeros(cells.shape[:-1], np.int64)
        for k in range(self.keys):
            out = out * 251 + cells[..., k] + 125
        return out

    def code_lead(self, cells: np.ndarray) -> np.ndarray:
        """The part of a code that names a group of buckets."""
        return self.code(np.where(np.arange(self.keys) < self.lead, cells, 0))


def perturbations(near: list[float], probes: int) -> list[tuple[int, ...]]:
    """Sets of the sorted wall distances by rising sum of squares, the empty one first; not two walls of one key."""
    order = sorted(range(len(near)), key=near.__getitem__)
    cost = [near[i] for i in order]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    half = len(near) // 2
    while heap and len(out) < probes:
        c, chosen = heapq.heappop(heap)
        walls = [order[i] for i in chosen]
        if len({w % half for w in walls}) == len(walls):
            out.append(tuple(walls))
        last = chosen[-1] + 1
        if last < len(cost):
            heapq.heappush(heap, (c + cost[last], (*chosen, last)))
            heapq.heappush(heap, (c - cost[last - 1] + cost[last], (*chosen[:-1], last)))
    return out


def vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


HASHED = "t int, lead long, is_query boolean, id long, vec array<double>, codes array<long>"


def hashed(h: Hashes, probes: int):
    """(id, vec, is_query) -> a row for each group that a vector lies in or a query has probes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids, x, asks = b.column(0).to_pylist(), vectors(b.column(1)), b.column(2).to_pylist()
                places = h.projected(x, False)
                cells = np.floor(places).astype(np.int64)
                full, lead = h.code(cells), h.code_lead(cells)
                rows: list[tuple] = [(t, int(lead[t, i]), False, ids[i], i, [int(full[t, i])]) for t in range(h.tables) for i in range(len(ids))]
                ask = [i for i, q in enumerate(asks) if q]
                if ask:
                    places = h.projected(x[ask], True)
                    cells = np.floor(places).astype(np.int64)
                    rest = places - cells
                    for t in range(h.tables):
                        for n, i in enumerate(ask):
                            low = rest[t, n] ** 2
                            sets = perturbations([*low, *((1 - rest[t, n]) ** 2)], probes)
                            spots = np.repeat(cells[t, n][None, :], len(sets), axis=0)
                            for s, walls in enumerate(sets):
                                for w in walls:
                                    spots[s, w % h.keys] += -1 if w < h.keys else 1
                            by: dict[int, list[int]] = {}
                            for g, c in zip(h.code_lead(spots).tolist(), h.code(spots).tolist(), strict=True):
                                by.setdefault(g, []).append(c)
                            rows += [(t, g, True, ids[i], i, cs) for g, cs in by.items()]
                t, g, q, who, at_, codes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t, pa.int32()), pa.array(g, pa.int64()), pa.array(q), pa.array(who, pa.int64()), b.column(1).take(pa.array(at_)), pa.array(codes, pa.list_(pa.int64()))],
                    names=["t", "lead", "is_query", "id", "vec", "codes"],
                )

    return run


FOUND = "query long, id long, score double"


def searched(k: int):
    """Sorted rows (t, lead, salt, is_query, id, vec, codes): a group's vectors, then its queries -> the best k of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, xs, codes = None, [], [], []
        table: tuple | None = None

        def ready() -> tuple:
            x, who, code = np.concatenate(xs), np.concatenate(ids), np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            return x[order], who[order], code[order]

        def answer(asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, who, code = table
            q, name = vectors(asked.column(5)), asked.column(4).to_numpy()
            # Twice what two ways of summing a product can differ by: within it, the exact score and the id decide.
            slack = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            probes = asked.column(6)
            owner = np.repeat(np.arange(len(q)), np.diff(probes.offsets.to_numpy()))
            spots = probes.flatten().to_numpy()
            lo, hi = np.searchsorted(code, spots), np.searchsorted(code, spots, side="right")
            some = hi > lo
            owner, lo, hi = owner[some], lo[some], hi[some]
            out: list[list[tuple]] = [[] for _ in range(len(q))]
            order = np.argsort(lo, kind="stable")
            edges = np.flatnonzero(np.diff(lo[order], prepend=-1, append=-1))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                mine = owner[order[s:e]]
                a, b = lo[order[s]], hi[order[s]]
                scores = q[mine] @ x[a:b].T
                if b - a > k:
                    cut = np.partition(scores, b - a - k, axis=1)[:, b - a - k] - slack[mine]
                else:
                    cut = np.full(len(mine), -np.inf)
                for i, v, least in zip(mine.tolist(), scores, cut, strict=True):
                    near = np.flatnonzero(v >= least)
                    out[i].append((near + a, v[near]))
            pick, own, exact = [], [], []
            for i, parts in enumerate(out):
                if parts:
                    cs, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    if len(v) > k:
                        cs = cs[v >= np.partition(v, len(v) - k)[len(v) - k] - slack[i]]
                    score = (q[i] * x[cs]).sum(axis=1)
                    best = np.lexsort((who[cs], -score))[:k]
                    pick.append(cs[best])
                    own.append(np.full(len(best), i))
                    exact.append(score[best])
            if pick:
                cs, own = np.concatenate(pick), np.concatenate(own)
                yield pa.RecordBatch.from_arrays([pa.array(name[own]), pa.array(who[cs]), pa.array(np.concatenate(exact))], names=["query", "id", "score"])

        for b in batches:
            t, g, s, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = np.flatnonzero((np.diff(t) != 0) | (np.diff(g) != 0) | (np.diff(s) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                part, key = b.slice(lo, hi - lo), (t[lo], g[lo], s[lo])
                if key != group:
                    group, ids, xs, codes, table = key, [], [], [], None
                if not asks[lo]:
                    ids.append(part.column(4).to_numpy())
                    xs.append(vectors(part.column(5)))
                    codes.append(part.column(6).flatten().to_numpy())
                elif ids:
                    table = table or ready()
                    for at in range(0, part.num_rows, BLOCK):
                        yield from answer(part.slice(at, BLOCK))

    return run


def nearest(
    rows: DataFrame, asks: str, k: int = 20, row_id: str = "vec_id", vector: str = "embedding", tables: int = 4, keys: int = 6, width: float = 2.0, probes: int = 150, lead: int = 3, seed: int = 7
) -> DataFrame:
    """``query_id, rank, <row_id>, score``: the k rows found nearest to each row that the SQL condition ``asks`` picks.

    Nearest is the largest inner product in double precision, ties to the smaller id; a row is never its own
    neighbour. Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows
    without an id or of another length than most. Equal vectors and repeated rows of one id are fine (one id
    counts once); fewer than k candidates give as many rows; no queries, no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    ok = rows.filter(F.col(vector).isNotNull() & F.col(row_id).isNotNull()).filter(fit).select(F.col(row_id).cast("long").alias("id"), x.alias("vec"), F.expr(asks).alias("asks"))
    shape = ok.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("top"))
    dims = shape.orderBy(F.desc("n"), "dim").first()
    result = f"query_id long, rank int, {row_id} long, score double"
    if dims is None:
        return spark.createDataFrame([], result)
    ok = ok.filter(F.size("vec") == dims["dim"])
    firsts = ok.dropDuplicates(["id", "vec"]).withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= k + 1)
    firsts = firsts.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    flags = ok.groupBy("vec").agg(F.max("asks").alias("asks"))
    classes = firsts.join(flags, "vec").select(F.element_at("ids", 1).alias("id"), "vec", "ids", "asks")
    classes = settle(classes, "ann-classes")
    h = Hashes(dims["dim"], float(dims["top"]) ** 0.5 * (1 + 1e-9), tables, keys, width, lead, seed)
    spread = settle(classes.select("id", "vec", "asks").mapInArrow(hashed(h, probes), HASHED), "ann-hashed")
    sizes = spread.filter("NOT is_query").groupBy("t", "lead").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    part = F.when(F.col("is_query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    dealt = spread.join(sizes, ["t", "lead"]).withColumn("salt", F.explode(part)).select("t", "lead", "salt", "is_query", "id", "vec", "codes")
    dealt = dealt.repartition("t", "lead", "salt").sortWithinPartitions("t", "lead", "salt", "is_query")
    found = dealt.mapInArrow(searched(k + 1), FOUND).distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    found = found.join(classes.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("near"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "near"))).filter(F.col("r") <= k + 1).select("query", "near", "score")
    found = settle(found, "ann-found")
    every = ok.filter("asks").select(F.col("id").alias("query_id"), "vec").distinct().join(classes.select(F.col("id").alias("query"), "vec"), "vec").select("query_id", "query")
    out = every.join(found, "query").filter("near <> query_id")
    out = out.groupBy("query_id", "near").agg(F.max("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "near"))).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("near").alias(row_id), "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")


ORACLE: dict[str, str] = {}
QUERIES = {"op10_nearest": op10_nearest}
