"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

1. One pass over the texts gives each document its shingle set's size and digest, SuperMinHash band keys
   and a byte per signature slot. Documents with one set are one class; only classes go on.
2. Classes that meet in a bucket of any band are compared by signature. In a bucket, leaders are picked in
   order: a class is no leader if an earlier leader's estimate reaches ``sure``; it is tied to every leader
   whose estimate reaches ``tied``. By the triangle inequality of Jaccard distance, two classes with a true
   link end up tied through a leader. Only a spanning forest of the ties is emitted, never the pairs. Large
   buckets are salted, and their leaders meet level by level.
3. Ties give families (a superset of the true groups). Each family's whole sets meet once, and every pair
   in it is verified exactly by a matrix product over the shingles that two of its classes share; a large
   family is cut into blocks, and each pair of blocks is a task of bounded size. What leaves a task is a
   spanning forest of verified links, grouped by union-find.

Two chances to lose a link remain, both of signatures: at the threshold itself a pair misses all bands with
probability 5e-8, and a tie to a leader is missed if its estimate is under 0.33 where 0.6 is the least that a
link allows, six standard errors off. Sets are compared whole, as the 64-bit hashes of their word runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, settle
from .components import components
from .shingles import Words, digest, mix, shingle_set, super_min_hash, words_of

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: A bucket, or a salted part of one, holds about this many classes at most.
PART = 4096
#: A task verifies about so many classes and shingles at once.
BLOCK, WEIGHT = 1000, 1_000_000
#: Up to so many ids of documents with ties (16 bytes each) are broadcast to pick the texts that are needed.
BROADCAST_IDS = 3_000_000


def signed(k: int):
    """Documents (id, text, mark) -> id, mark, n, digest, keys, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()

        def out(ids: list, marks: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            sig = super_min_hash(np.concatenate(sets), owner, len(sets), SLOTS)
            bits = mix(sig.view(np.uint64))
            keys = np.zeros((len(sets), BANDS), np.uint64)
            for i in range(ROWS):
                keys = mix(keys + bits[:, i::ROWS])
            keys = np.where((sizes > 0)[:, None], keys, np.uint64(0)).view(np.int64)
            low = (bits & np.uint64(255)).astype(np.uint8)
            rows = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes), pa.array([digest(s) for s in sets], pa.binary()), rows]
                + [pa.array([r.tobytes() for r in low], pa.binary())],
                names=["id", "mark", "n", "digest", "keys", "sig"],
            )

        for b in batches:
            ids, marks, sets, total = [], [], [], 0
            for who, text, mark in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids.append(who)
                marks.append(mark)
                sets.append(shingle_set(words_of(text.as_py(), lower=True), k, memo))
                total += len(sets[-1])
                if total > 400_000:
                    yield out(ids, marks, sets)
                    ids, marks, sets, total = [], [], [], 0
            if ids:
                yield out(ids, marks, sets)
        give_back()

    return run


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of a partition sorted by its first ``keys`` columns, group by group."""
    group: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and group[-1][:keys] != row[:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def forest(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spanning forest of links i - js, and the least member of each one's tree."""
    root, edges = np.arange(n), []
    for i, js in pairs:
        for r in np.unique(root[js]):
            if r != root[i]:
                low, high = min(r, root[i]), max(r, root[i])
                edges.append((int(low), int(high)))
                root[root == high] = low
    return edges, root


def led(sure: float, tied: float):
    """Sorted rows (band, key, salt, id, sig) -> ties (u, v) with band null, and leaders with u null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("band", pa.int32()), ("key", pa.int64()), ("salt", pa.int64()), ("id", pa.int64()), ("sig", pa.binary())])
        names = schema.names
        for group in grouped(batches, 3):
            ids = [g[3] for g in group]
            sigs = np.frombuffer(b"".join(g[4] for g in group), np.uint8).reshape(len(group), -1)
            free = np.ones(len(group), bool)
            leaders = []

            def ties(free=free, sigs=sigs, leaders=leaders) -> Iterator[tuple[int, np.ndarray]]:
                while free.any():
                    i = int(free.argmax())
                    leaders.append(i)
                    like = ((sigs == sigs[i]).mean(axis=1) - 1 / 256) * (256 / 255)
                    free &= like < sure
                    free[i] = False
                    yield i, np.flatnonzero(like >= tied)

            edges, _ = forest(len(group), ties())
            rows += [(ids[i], ids[j], None, None, None, None, None) for i, j in edges]
            rows += [(None, None, *group[i]) for i in leaders]
            if len(rows) > 5000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    return run


LED = "u long, v long, band int, key long, salt long, id long, sig binary"


def families(classes: DataFrame) -> DataFrame:
    """(node, root): classes (id, keys, sig) that ties connect. Classes without ties are left out."""
    rows = classes.select("id", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    shared = settle(shared.select("band", "key", "n"), "near-shared")
    most = shared.agg(F.max("n")).first()[0]
    if most is None:
        return components(classes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0))
    met = rows.join(shared, ["band", "key"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PART)))
    at = settle(met.join(classes.select("id", "sig"), "id").select("band", "key", "salt", "id", "sig"), "near-met")
    ties, parts, first = [], -(-most // PART), True
    while True:
        spread = at.repartition("band", "key", "salt").sortWithinPartitions("band", "key", "salt", "id")
        got = settle(spread.mapInArrow(led(0.8, 0.33 if first else 0.1), LED), "near-led")
        ties.append(got.filter("u IS NOT NULL").select("u", "v"))
        if parts <= 1:
            break
        parts, first = -(-parts // 64), False
        at = got.filter("u IS NULL").select("band", "key", F.floor(F.col("salt") / 64).cast("long").alias("salt"), "id", "sig")
    every = ties[0]
    for t in ties[1:]:
        every = every.unionByName(t)
    return components(every, "near-families")


def linked(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each set, in turn, those with 100 * intersection >= percent * union, exactly; itself included."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        inter = np.array([[sizes[0], both], [both, sizes[1]]])
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        del order
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        often = ~(new & np.append(new[1:], True))  # shingles of two sets and more
        column, owner = np.cumsum(new[often]) - 1, owner[often]
        del flat, new, often
        step = max(1, 4_000_000 // n)
        inter = np.zeros((n, n), np.float32 if sizes.max() < 1 << 24 else np.float64)  # whole numbers, exactly
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            lo, hi = np.searchsorted(column, [k, k + step])
            m = np.zeros((n, step), np.float32)
            m[owner[lo:hi], column[lo:hi] - k] = 1
            inter += m @ m.T
    for i in range(n):
        own = inter[i].astype(np.int64)
        own[i] = sizes[i]
        yield i, np.flatnonzero(100 * own >= percent * (sizes[i] + sizes - own))


def verified(k: int, percent: int):
    """Sorted rows (family, bi, bj, node, digest, text) -> spanning links (u, v) between classes of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rows = Words(), []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])

        def groups() -> Iterator[dict[int, np.ndarray]]:
            now, held = None, {}
            for b in batches:
                for f, bi, bj, who, own, text in zip(*(b.column(i) for i in range(6)), strict=True):
                    key = (f.as_py(), bi.as_py(), bj.as_py())
                    if key != now and held:
                        yield held
                        held = {}
                    now = key
                    got = shingle_set(words_of(text.as_py(), lower=True), k, memo)
                    if digest(got) == own.as_py():
                        held[who.as_py()] = got
            if held:
                yield held

        for held in groups():
            if len(held) > 1:
                ids = sorted(held)
                edges, _ = forest(len(ids), linked([held[i] for i in ids], percent))
                rows += [(ids[i], ids[j]) for i, j in edges]
                if len(rows) > 5000:
                    yield out()
                    rows = []
        if rows:
            yield out()
        give_back()

    return run


def near_dup(docs: DataFrame, k: int = 5, percent: int = 80, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``<row_id>, n_shingles, component_id, kept``.

    Words are maximal runs without ASCII white space, with A to Z lower-cased; a document's set holds its
    distinct runs of ``k`` words, or all its words as one if there are fewer. Documents are linked if 100
    times the intersection is at least ``percent`` times the union; ``component_id`` is the least id that
    links reach, and the document of that id is kept. Null or blank texts have an empty set and are linked
    with nothing. A row without an id is linked with nothing, has no component and is kept. Rows that
    repeat an id are judged each by its own text. Ids are whole numbers (or strings of them). No rows in, no
    rows out; other columns are ignored. ``mark``, a 64-bit hash of the text, tells rows of one id apart, and
    ``group`` tells groups apart whose least ids are the same; it is null for what cannot be linked.
    """
    source = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    signs = settle(source.mapInArrow(signed(k), "id long, mark long, n long, digest binary, keys array<long>, sig binary"), "near-signs")
    able = signs.filter("n > 0 AND id IS NOT NULL")
    reps = able.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("rep"))
    classes = able.join(reps.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("rep.id")) & (F.col("mark") == F.col("rep.mark")))
    classes = classes.select("id", "mark", "digest", "n", "keys", "sig").dropDuplicates(["digest"])
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "near-reps")  # numbers hold once written
    family = families(classes.select(F.col("node").alias("id"), "keys", "sig"))
    family = family.select(F.col("node").alias("tied"), F.col("root").alias("family"))
    members = settle(classes.select("id", "node", "digest", "n").join(family, F.col("node") == F.col("tied")).drop("tied"), "near-members")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / WEIGHT)).cast("long").alias("blocks"))
    members = members.join(sizes, "family")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
    )
    members = settle(members.select("id", "node", "digest", "family", pairs.alias("pairs")), "near-blocks")
    if members.count() <= BROADCAST_IDS:  # else every text goes to meet its family, if any
        source = source.join(F.broadcast(members.select("id").distinct()), "id", "left_semi")
    whole = source.join(members.hint("merge"), "id").select("family", F.explode("pairs").alias("p"), "node", "digest", "text")
    whole = whole.select("family", "p.i", "p.j", "node", "digest", "text").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    links = settle(whole.mapInArrow(verified(k, percent), "u long, v long"), "near-links")
    found = components(links, "near-groups").withColumnRenamed("node", "linked")
    grouped_ = classes.select("id", "node", "digest").join(found, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "node"))
    grouped_ = settle(grouped_.select(F.col("digest").alias("d"), "id", "root"), "near-named")
    least = grouped_.groupBy("root").agg(F.min("id").alias("component"))
    named = signs.join(grouped_.join(least, "root").select("d", "component", F.col("root").alias("group")), (F.col("digest") == F.col("d")) & (F.col("n") > 0), "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "id"))
    return named.select(
        F.col("id").alias(row_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "mark", F.when(F.col("id").isNotNull(), F.col("group")).alias("group")
    )


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4).drop("mark", "group")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays (five-word shingles, 0.8).

    The row of the least id stays, of several with that id the one of the least hash; rows alike in id and
    text stay or go together. Rows without id or words stay; no rows in, no rows out; all columns are kept.
    """
    rows = settle(near_dup(docs).filter("group IS NOT NULL").select("doc_id", "mark", "component_id", "group"), "near-stage")
    stays = rows.filter("doc_id = component_id").groupBy("group").agg(F.min("mark").alias("least"))
    gone = rows.join(stays, "group").filter("doc_id <> component_id OR mark <> least").select("doc_id", "mark").distinct()
    return docs.withColumn("mark", F.xxhash64("text")).join(gone, ["doc_id", "mark"], "left_anti").select(*docs.columns)


ORACLE = {
    "op9_near_dup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS sh
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        link AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        walk AS (
            SELECT doc_id AS u, doc_id AS v FROM documents
            UNION SELECT walk.u, link.v FROM walk JOIN link ON walk.v = link.u)
        SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(walk.v) AS component_id, d.doc_id = min(walk.v) AS kept
        FROM documents d JOIN walk ON walk.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
}
QUERIES = {"op9_near_dup": op9_near_dup}
