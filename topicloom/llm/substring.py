"""Substring dedup by a corpus-wide word suffix tree that is split by prefix and never whole anywhere.

All suffixes of all documents, by words, form one suffix tree; an internal node at least ``window`` words deep
with leaves in several documents is a repeat, and of its leaves those of the smallest document stay.

1. Prefixes are counted. The prefix of a suffix is read at its pivot, the half-window of least hash within its
   first ``window`` words: equal windows have equal pivots, and neighbours mostly share one, so that they travel
   as one stretch. A prefix that a single document has lies over leaves only and goes no further.
2. Prefixes have variable length: one that more than ``crowd`` suffixes share is lengthened to the whole
   window. Groups of prefixes are sized by the counts, so that a task holds about ``GROUP`` suffixes; a window
   that stands in very many files is met part by part, and what stays in a part goes on to the next level.
3. Each group's subtree is built by sorting its suffixes: ranks by one word, then by prefixes of growing length
   made of ranks, exactly, down to the depth that decides. Suffixes of one rank hang below one internal node.
   Each batch of documents settles its own subtree before anything is shipped, so a passage that stands in a
   third of all documents reaches its group once per batch.

Consecutive suffixes below such nodes make a maximal repeat: a span of words to remove. Documents are written
to the shared folder once; every pass reads those files where they lie, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, settle
from .shingles import G, mix

#: Bytes of text in a batch that settles its own repeats.
BATCH_BYTES = 6 << 20
#: Bytes of stored text whose prefixes one task counts.
COUNT_BYTES = 32 << 20
#: Suffixes that a group holds, about.
GROUP = 300_000
#: Suffixes that may share a prefix; beyond that it is lengthened.
CROWD = 100_000
#: Files whose copies of a very common window meet at once.
SALT_FILES = 20_000
#: Bytes hashed at once.
CHUNK = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.where(_SPACE, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * G))


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _long_word(raw: np.ndarray) -> int:
    parts = ((at, raw[at : at + CHUNK]) for at in range(0, len(raw), CHUNK))
    return sum(int((_BYTE[x] * _POWER[: len(x)]).sum()) * pow(_BASE, at, 1 << 64) for at, x in parts) % (1 << 64)


def hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word of a text (bytes), and where it starts and ends."""
    zero = np.int8(0)
    edge = np.flatnonzero(np.diff((~_SPACE[raw]).view(np.int8), prepend=zero, append=zero))
    start, end = edge[::2], edge[1::2]
    h = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + CHUNK, side="right"))
        if j <= i:
            h[i] = _long_word(raw[start[i] : end[i]])
            i += 1
            continue
        s = start[i:j] - start[i]
        value = _BYTE[raw[start[i] : end[j - 1]]]
        value *= _POWER[: len(value)]
        h[i:j] = np.add.reduceat(value, s) * _INVERSE[s]
        i = j
    return mix(h + (end - start).astype(np.uint64) * G), start, end


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * G + b + np.uint64(1))


def fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    """64-bit fingerprint of each run of ``window`` words, by doubling."""
    out, length, power, size = None, 0, h, 1
    n = len(h) - window + 1
    while True:
        if window & size:
            out = power[:n] if out is None else join(out, power[length : length + n])
            length += size
        if 2 * size > window:
            return out
        power, size = join(power[:-size], power[size:]), 2 * size


def least(g: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    step = 1
    while 2 * step <= width:
        g, step = np.minimum(g[:-step], g[step:]), 2 * step
    rest = width - step
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def pivots(h: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` words, the least hash (48 bits) of half a window that lies in it."""
    words = max(1, window // 2) if window >= 4 else window
    return least(fingerprints(h, words), window - words + 1) >> np.uint64(16)


class Ids(dict):
    """Word -> number, in order of appearance; exact."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def ranked(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each key among the distinct ones, and how many there are."""
    order = np.argsort(keys)
    new = np.concatenate([[0], keys[order][1:] != keys[order][:-1]])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1


def nodes(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The node ``window`` words deep above the suffix at each place ``at``, numbered in the tree's order.

    Suffixes are sorted by prefixes of 1, 3, 9, ... words (2, 4, ... of a very large group): the rank of a longer
    prefix is that of its parts' ranks in turn, so equal ranks are equal words.
    """
    rank, size, depth = ids, int(ids.max()) + 1, 1
    if window == 1:
        return rank[at]
    while depth < window:
        parts = 3 if size**3 < 1 << 62 and 2 * depth < window else 2
        goal = min(parts * depth, window)
        place = at if goal == window else np.arange(len(ids) - goal + 1)
        key = rank[place]
        for shift in ((goal - depth) // 2, goal - depth)[3 - parts :]:
            key = key * size + rank[place + shift]
        (rank, size), depth = ranked(key), goal
    return rank


def repeats(ids: np.ndarray, at: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes hang below a node, ``window`` words deep, with a leaf in a smaller document."""
    node = nodes(ids, at, window)
    order = np.argsort(node)
    new = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
    first = np.repeat(np.minimum.reduceat(docs[order], new), np.diff(new, append=len(order)))
    out = np.empty(len(at), bool)
    out[order] = docs[order] > first
    return out


def stretches(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive places ``at`` on which all of ``same`` agree."""
    cut = np.diff(at) != 1
    for x in same:
        cut |= x[1:] != x[:-1]
    cut = np.flatnonzero(cut) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, compressed."""
    x = np.ascontiguousarray(x, np.int64)
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def opened(blob: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(np.int64).ravel()


def batches_of(path: str) -> Iterator[tuple[int, list[int | None], list[bytes]]]:
    """A file's documents in batches: number of the first row, ids, texts (null: empty)."""
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(base) as source:
        row, ids, texts, size = 0, [], [], 0
        for b in pq.ParquetFile(source).iter_batches(512, columns=["id", "text"], use_threads=False):
            for who, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(who)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield row, ids, texts
                    row, ids, texts, size = row + len(ids), [], [], 0
        yield row, ids, texts


class Windows:
    """The windows of a batch of documents and their prefixes."""

    def __init__(self, ids: list[int | None], texts: list[bytes], window: int) -> None:
        texts = [b"" if i is None else t for i, t in zip(ids, texts, strict=True)]
        self.raw = b"\n".join(texts)
        self.h, self.start, self.end = hashed_words(np.frombuffer(self.raw, np.uint8))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.owner = np.searchsorted(begin, self.start, side="right") - 1
        n = len(self.h) - window + 1
        self.at = np.flatnonzero(self.owner[:n] == self.owner[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if len(self.at):
            self.key = pivots(self.h, window)[self.at].astype(np.int64)
            self.first, last = stretches(self.at, self.key, self.owner[self.at])
            self.count = last - self.first + 1
            key = self.key[self.first]
            self.order = np.argsort(key, kind="stable")
            self.new = np.concatenate([[True], np.diff(key[self.order]) != 0])

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct prefixes, sorted; twice the windows of each, and one more if several documents have it."""
        new = np.flatnonzero(self.new)
        docs = self.owner[self.at[self.first]][self.order]
        several = np.maximum.reduceat(docs, new) > np.minimum.reduceat(docs, new)
        return self.key[self.first][self.order][new], 2 * np.add.reduceat(self.count[self.order], new) + several

    def spread(self, states: np.ndarray) -> np.ndarray:
        """What is known of the distinct prefixes, for each window."""
        out = np.empty(len(self.order), states.dtype)
        out[self.order] = states[np.cumsum(self.new) - 1]
        return np.repeat(out, self.count)

    def words(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The text from each first word to each last one."""
        return [self.raw[a:b] for a, b in zip(self.start[first].tolist(), self.end[last].tolist(), strict=True)]


COUNTED = "bucket int, file int, path string, batch int, keys binary, counts binary"
STATES = "file int, path string, batch int, bucket int, states binary, fits long, crowded long"
#: Stretches to meet others in a bucket; spans to remove have no text (blob), and no bucket once they are final.
ROWS = "bucket int, salt int, file int, rows binary, ids binary, starts binary, ends binary, blob binary"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def dealt(rows: Iterator[tuple], schema: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + sum(len(x) for x in r if isinstance(x, bytes))
        if size > most:
            yield batch_of(held, schema)
            held, size = [], 0
    if held:
        yield batch_of(held, schema)


def batched(rows, schema: str):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from dealt(rows(batches), schema)

    return run


def counted(window: int, buckets: int):
    """Files (file, path) -> the prefixes of each batch, by bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for file, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for number, (_, ids, texts) in enumerate(batches_of(path)):
                    found = Windows(ids, texts, window)
                    if len(found.at):
                        keys, counts = found.prefixes()
                        bucket = np.minimum((keys * (buckets / 2.0**48)).astype(np.int64), buckets - 1)
                        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
                        for lo, hi in zip(cut, cut[1:], strict=False):
                            yield int(bucket[lo]), file, path, number, squeezed(np.diff(keys[lo:hi], prepend=0)), squeezed(counts[lo:hi])
        give_back()

    return batched(rows, COUNTED)


def judged(crowd: int):
    """All prefixes of a bucket -> for each batch which it should go on with: 0 none, 1 those that fit, 2 crowded ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        who, keys, counts = [], [], []
        for b in batches:
            for bucket, file, path, number, k, c in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                who.append((file, path, number, bucket))
                keys.append(np.cumsum(opened(k)))
                counts.append(opened(c))
        if not who:
            return
        sizes = np.array([len(k) for k in keys])
        key, count = np.concatenate(keys), np.concatenate(counts)
        del keys, counts
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        times = np.diff(new, append=len(order))
        several = (times > 1) | (np.maximum.reduceat(count[order] & 1, new) > 0)
        state = np.where(several, np.where(np.add.reduceat(count[order] >> 1, new) > crowd, 2, 1), 0).astype(np.uint8)
        out = np.empty(len(order), np.uint8)
        out[order] = np.repeat(state, times)
        count >>= 1
        for w, hi, n in zip(who, np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            own, c = out[hi - n : hi], count[hi - n : hi]
            yield *w, zstandard.compress(own.tobytes(), 1), int(c[own == 1].sum()), int(c[own == 2].sum())

    return batched(rows, STATES)


def shipped(window: int, fits: int, crowded: int):
    """States, sorted by file, batch and bucket -> each batch's own spans, and the stretches that go to buckets."""

    def ship(file: int, row: int, ids: list[int | None], found: Windows, states: np.ndarray) -> Iterator[tuple]:
        state = found.spread(states)
        some = np.flatnonzero(state)
        if not len(some):
            return
        state, at = state[some], found.at[some]
        who = np.array([0 if i is None else i for i in ids], np.int64)
        owner = found.owner[at]
        begin = np.searchsorted(found.owner, np.arange(len(ids)))
        covered = np.zeros(len(found.h) + 1, np.int8)
        covered[at] += 1
        covered[at + window] -= 1
        covered = np.cumsum(covered, dtype=np.int64)[:-1] > 0
        words = np.flatnonzero(covered)
        f, t = stretches(words)
        text = b" ".join(found.words(words[f], words[t])).split()
        marked = repeats(Ids().of(text), (np.cumsum(covered) - 1)[at], who[owner], window)
        del text
        m = np.flatnonzero(marked)
        if len(m):
            f, t = stretches(at[m], owner[m])
            f, t = m[f], m[t]
            o = owner[f]
            yield int(who[o[0]] % fits), 0, file, squeezed(row + o), squeezed(who[o]), squeezed(at[f] - begin[o]), squeezed(at[t] - begin[o] + window), b""
        go = np.flatnonzero(~marked)
        if not len(go):
            return
        at, owner, crowd = at[go], owner[go], state[go] == 2
        key = found.key[some][go]
        bucket = (mix(key.astype(np.uint64)) % np.uint64(fits)).astype(np.int64)
        if crowd.any():
            key[crowd] = fingerprints(found.h, window)[at[crowd]].view(np.int64)
            bucket[crowd] = fits + (mix(key[crowd].view(np.uint64)) % np.uint64(crowded)).astype(np.int64)
        f, t = stretches(at, key, owner)
        order = np.lexsort((key[f], bucket[f]))
        f, t = f[order], t[order]
        first, last, bucket, own = at[f], at[t] + window, bucket[f], owner[f]
        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            x, o, a, z = int(bucket[lo]), own[lo:hi], first[lo:hi], last[lo:hi]
            blob = zstandard.compress(b"\n".join(found.words(a, z - 1)), 3)
            yield x, file // SALT_FILES if x >= fits else 0, file, squeezed(row + o), squeezed(who[o]), squeezed(a - begin[o]), squeezed(z - begin[o]), blob

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        every = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True))
        for (file, path), own in groupby(every, lambda r: r[:2]):
            states: dict[int, list[bytes]] = {}
            for _, _, number, x in own:
                states.setdefault(number, []).append(x)
            for number, (row, ids, texts) in enumerate(batches_of(path)):
                if number in states:
                    known = np.frombuffer(b"".join(map(zstandard.decompress, states.pop(number))), np.uint8)
                    if known.any():
                        yield from ship(file, row, ids, Windows(ids, texts, window), known)
        give_back()

    return batched(rows, ROWS)


def met(window: int, fits: int, last: bool):
    """All rows of a group -> spans to remove, by file, without a bucket; and what stays of a group to be met again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number, held, ids, group, salt = Ids(), [], [], 0, 0
        for b in batches:
            for group, salt, file, *blobs, blob in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if not blob:
                    yield -1, 0, file, *blobs, b""
                    continue
                ids.append(number.of(zstandard.decompress(blob).split()))
                r, who, s, e = map(opened, blobs)
                held.append((np.full(len(r), file), r, who, s, e))
        if not ids:
            return
        ids = np.concatenate(ids)
        file, row, who, start, end = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        known = list(number) if group >= fits and not last else []
        number.clear()
        count = end - start
        owner = np.repeat(np.arange(len(count)), count)
        begin = np.cumsum(count) - count
        at = np.flatnonzero(owner[: len(ids) - window + 1] == owner[window - 1 :])
        owner = owner[at]
        marked = repeats(ids, at, who[owner], window)

        def spans(chosen: np.ndarray) -> tuple[np.ndarray, ...]:
            f, t = stretches(at[chosen], owner[chosen])
            f, t = chosen[f], chosen[t]
            o = owner[f]
            order = np.argsort(file[o], kind="stable")
            f, t, o = f[order], t[order], o[order]
            return o, at[f], at[t] + window, np.flatnonzero(np.diff(file[o], prepend=-1, append=-1))

        for chosen, again in ((np.flatnonzero(marked), False), (np.flatnonzero(~marked), True)):
            if not len(chosen) or again and not known:
                continue
            o, a, z, cut = spans(chosen)
            shift = start[o] - begin[o]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own = slice(lo, hi)
                places = (squeezed(row[o[own]]), squeezed(who[o[own]]), squeezed((a + shift)[own]), squeezed((z + shift)[own]))
                text = zstandard.compress(b"\n".join(b" ".join([known[i] for i in ids[x:y].tolist()]) for x, y in zip(a[own], z[own], strict=True)), 3) if again else b""
                yield group if again else -1, salt, int(file[o[lo]]), *places, text
        give_back()

    return batched(rows, ROWS)


def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files and their spans, sorted by file -> id, n_words, n_removed, kept (the words left, joined by one space)."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        who, n, removed, kept = zip(*rows, strict=True)
        arrays = [pa.array(who, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "n_removed", "kept"])

    every = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
    for _, own in groupby(every, lambda r: r[0]):
        path, spans = None, []
        for _, p, *blobs in own:
            if p is None:
                spans.append([opened(x) for x in blobs])
            else:
                path = p
        row, start, end = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
        order = np.argsort(row, kind="stable")
        row, start, end = row[order], start[order], end[order]
        out, size = [], 0
        for first, ids, texts in batches_of(path):
            cut = np.searchsorted(row, np.arange(first, first + len(ids) + 1)).tolist()
            for who, text, lo, hi in zip(ids, texts, cut, cut[1:], strict=False):
                left = words = text.split()
                if hi > lo:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, start[lo:hi], 1)
                    np.subtract.at(gone, end[lo:hi], 1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                out.append((who, len(words), len(words) - len(left), b" ".join(left)))
                size += len(text)
                if size > 1 << 20:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)
    give_back()


def repeated_spans(files: DataFrame, n_files: int, stored: int, window: int, crowd: int) -> DataFrame:
    """``file, rows, starts, ends``: spans of words to remove, packed, of files (file, path) of documents (id, text)."""
    spark = files.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, -(-stored // COUNT_BYTES))
    counts = files.repartitionById(n_files, F.col("file")).mapInArrow(counted(window, buckets), COUNTED)
    states = settle(counts.groupBy("bucket").applyInArrow(judged(crowd), STATES), "substring-prefixes")
    total = states.agg(F.sum("fits"), F.sum("crowded")).first()
    fits, crowded = (max(tasks, -(-(n or 0) // GROUP)) for n in total)
    sent = states.repartitionById(n_files, F.col("file")).sortWithinPartitions("file", "batch", "bucket").mapInArrow(shipped(window, fits, crowded), ROWS)
    found, parts = [], -(-n_files // SALT_FILES)
    while True:
        got = settle(sent.groupBy("bucket", "salt").applyInArrow(met(window, fits, parts == 1), ROWS), "substring-spans")
        found.append(got.filter("bucket < 0").select("file", "rows", "starts", "ends"))
        if parts == 1:
            break
        parts = -(-parts // 64)
        sent = got.filter("bucket >= 0").withColumn("salt", F.floor(F.col("salt") / 64).cast("int"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def substring_dedup(docs: DataFrame, window: int = 13, row_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per row: ``<row_id>, n_words, n_removed, kept`` (the words that stay, joined by one space).

    Words are maximal runs without ASCII white space, unchanged. A word goes if a run of ``window`` words
    that covers it also starts in a document with a smaller id; all runs are judged on the input. Null text
    has no words. A row without an id loses nothing and costs others nothing; rows that repeat an id are
    not smaller than each other and are judged each by its own text. Documents under ``window`` words lose
    nothing. No rows in, no rows out; other columns are ignored. Ids are whole numbers (or strings of them).
    """
    spark = docs.sparkSession
    held = settle(docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text")), "substring-texts")
    paths = sorted(held.inputFiles())
    schema = "id long, n_words long, n_removed long, kept string"
    if not paths:
        return spark.createDataFrame([], schema).withColumnRenamed("id", row_id)
    files = spark.createDataFrame(list(enumerate(paths)), "file int, path string")
    stored = int(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    found = repeated_spans(files, len(paths), stored, window, crowd)
    none = F.lit(None)
    every = found.select("file", none.cast("string").alias("path"), "rows", "starts", "ends").unionByName(
        files.select("file", "path", *[none.cast("binary").alias(c) for c in ("rows", "starts", "ends")])
    )
    out = every.repartitionById(len(paths), F.col("file")).sortWithinPartitions("file").mapInArrow(kept_words, schema)
    return out.withColumnRenamed("id", row_id)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = {
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k
            FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM w) WHERE first < doc_id),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM d WHERE len(ws) > 0),
        left_ AS (
            SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS kept
            FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN left_ USING (doc_id)""",
}
QUERIES = {"op5_substring_dedup": op5_substring_dedup}
