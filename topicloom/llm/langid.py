"""Language identification as multilingual mixture inference.

A document is a mixture of languages. Each word (run of letters) has a likelihood under each language, the
product of its character trigrams' probabilities; expectation-maximisation over the document's words
estimates the language proportions. Which languages are in it is chosen by penalised likelihood (BIC): the
languages join in the order of their proportions, each set is refitted alone, and the set grows as long as the
likelihood gains more than the penalty of one more free proportion.

The trigram tables are fitted on a bounded sample of labelled rows and have a fixed size per language;
prediction is one pass over all texts, by vectorised numpy in Arrow functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back

#: Trigrams are hashed to so many counters for each language.
TABLE = 1 << 15
#: The classifier is fitted on about so many labelled documents of each language at most, chosen by a hash of their ids.
SAMPLE = 5_000
#: Parts in which counters are added up before they meet.
PARTS = 64
#: Characters worked on at once.
CHUNK = 1 << 20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters[points]


def slots(text: str, at: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of CHUNK characters of a lower-cased text: the table slot of the trigram round each letter, which of
    them begin words, and whether the first goes on with the word before."""
    part = (text[at - 1] if at else " ") + text[at : at + CHUNK] + (text[at + CHUNK : at + CHUNK + 1] or " ")
    points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(letters(points), points, 0)
    place = np.flatnonzero(points[1:-1]) + 1
    h = (points[place - 1] * 0x2C1B3C6D + points[place] * 0x297A2D39 + points[place + 1] * 0x1B56C4E9) & 0xFFFFFFFF
    h = ((h ^ (h >> 15)) * 0x2545F491) & 0xFFFFFFFF
    begin = np.flatnonzero(points[place - 1] == 0)
    return (h ^ (h >> 13)) & (TABLE - 1), begin, bool(len(place)) and (not len(begin) or begin[0] > 0)


def word_logs(text: str, table: np.ndarray) -> np.ndarray:
    """(words, languages): log likelihood of each word of a text; a word of any length is one word."""
    text, out = text.lower(), []
    for at in range(0, len(text), CHUNK):
        found, begin, goes_on = slots(text, at)
        if len(found):
            got = np.add.reduceat(table[found], np.append(0, begin) if goes_on else begin, axis=0)
            if goes_on:
                out[-1][-1] += got[0]
            out.append(got[1:] if goes_on else got)
            if not len(out[-1]):
                out.pop()
    return np.concatenate(out) if out else np.zeros((0, table.shape[1]))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts (lang, text) -> a row of counters for each language that a partition holds."""
    tables: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            table = tables.setdefault(lang, np.zeros(TABLE, np.int64))
            lower = (text.as_py() or "").lower()
            for at in range(0, len(lower), CHUNK):
                table += np.bincount(slots(lower, at)[0], minlength=TABLE)
    if tables:
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(tables)), pa.array([part] * len(tables), pa.int32()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], names=["lang", "part", "counts"]
        )


def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of a group, added up one by one."""
    total, lang = np.zeros(TABLE, np.int64), None
    for b in rows:
        lang = b.column(0).slice(0, 1)
        for x in b.column(2):
            total += np.frombuffer(x.as_py(), np.int64)
    if lang is not None:
        yield pa.RecordBatch.from_arrays([lang, pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["lang", "part", "counts"])


COUNTS = "lang string, part int, counts binary"


def held_out(row_id: Column) -> Column:
    """Rows that nothing may be learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(labelled: DataFrame, row_id: str, text: str, lang: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigrams, (languages, TABLE).

    Of a language with more than ``sample`` labelled rows, those are read whose id's hash falls into one of
    as many equal classes as there are samples' worth of rows; a rare language is read whole.
    """
    labelled = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).withColumn(lang, F.col(lang).cast("string"))
    many = {r[0]: -(-r[1] // sample) for r in labelled.groupBy(lang).count().collect() if r[1] > sample}
    classes = F.lit(1)
    for name, n in many.items():
        classes = F.when(F.col(lang) == name, F.lit(n)).otherwise(classes)
    if many:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.col(row_id)), classes) == 0)
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(counted, COUNTS)
    rows = rows.groupBy("lang", "part").applyInArrow(summed, COUNTS).groupBy("lang").applyInArrow(summed, COUNTS).orderBy("lang").collect()
    if not rows:
        return [], np.zeros((0, TABLE))
    counts = np.stack([np.frombuffer(r["counts"], np.int64) for r in rows]).astype(float) + 0.1
    return [r["lang"] for r in rows], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: proportions and log likelihood of each.

    ``like`` (words, languages) is scaled so that each word's best is 1; ``first`` is where each document's
    words begin; ``allowed`` (documents, languages) are the languages that it may mix.
    """
    sizes = np.diff(np.append(first, len(like)))
    part = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        joint = like * np.repeat(part, sizes, axis=0)
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        part = np.add.reduceat(joint, first, axis=0) / sizes[:, None]
    total = np.log(np.maximum((like * np.repeat(part, sizes, axis=0)).sum(axis=1), 1e-30))
    return part, np.add.reduceat(total, first)


def inferred(like: np.ndarray, first: np.ndarray, steps: int = 10) -> np.ndarray:
    """(documents, languages): proportions in the set that is chosen for each document, 0 outside it."""
    n, k = len(first), like.shape[1]
    sizes = np.diff(np.append(first, len(like)))
    full, _ = mixtures(like, first, np.ones((n, k)), steps)
    order = np.argsort(-full, axis=1, kind="stable")
    best, chosen, allowed = np.full(n, np.inf), np.zeros((n, k)), np.zeros((n, k))
    grows = np.arange(n)  # documents whose set may still grow
    for m in range(k):
        allowed[grows, order[grows, m]] = 1
        words = sizes[grows]
        mine = like if len(grows) == n else like[np.repeat(first[grows] - (np.cumsum(words) - words), words) + np.arange(words.sum())]
        part, total = mixtures(mine, np.cumsum(words) - words, allowed[grows], steps if m else 1)
        cost = -2 * total + m * np.log(words + 1)
        better = cost < best[grows]
        grows, part = grows[better], part[better]
        if not len(grows):
            break
        best[grows], chosen[grows] = cost[better], part
    return chosen


FOUND = "lang_pred string, score double, languages array<string>, proportions array<double>"


def predicted(langs: list[str], logs: np.ndarray):
    """(id, held_out, text) -> id, held_out and what FOUND names."""
    table = np.ascontiguousarray(logs.T)  # (TABLE, languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            names, shares = [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            likes: list[np.ndarray] = []
            which: list[int] = []
            words = 0

            def infer(likes=likes, which=which, pred=pred, score=score, names=names, shares=shares) -> None:
                sizes = [len(x) for x in likes]
                got = inferred(np.concatenate(likes), np.cumsum([0, *sizes[:-1]]))
                order = np.argsort(-got, axis=1, kind="stable")
                ranked = np.clip(np.take_along_axis(got, order, axis=1), 0.0, 1.0)
                for i, own, part, m in zip(which, order.tolist(), ranked.tolist(), (got > 0).sum(axis=1).tolist(), strict=True):
                    names[i], shares[i] = [langs[x] for x in own[:m]], part[:m]
                    pred[i], score[i] = names[i][0], part[0]
                likes.clear()
                which.clear()

            for i, text in enumerate(b.column(2)):
                got = word_logs(text.as_py() or "", table) if langs else ()
                if len(got):
                    which.append(i)
                    likes.append(np.exp(got - got.max(axis=1, keepdims=True)))
                    words += len(got)
                    if words > 200_000:
                        infer()
                        words = 0
            if which:
                infer()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(pred), pa.array(score), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["id", "held_out", "lang_pred", "score", "languages", "proportions"],
            )
        give_back()

    return run


def language(docs: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per row: ``<row_id>, held_out, lang_pred, score, languages, proportions``.

    Learned only from rows with text and label that are not held out. A null text, or one without a letter,
    is ``und`` with score 0, as is every text if nothing is labelled; ``score`` is else the proportion of
    the language predicted. Repeated rows get the same answer; no rows in, no rows out; other columns are
    ignored. ``languages`` and ``proportions`` are the chosen set, the largest share first, empty for ``und``.
    """
    langs, logs = fit(docs.filter(~held_out(F.col(row_id))), row_id, text, lang, sample)
    kind = docs.schema[row_id].dataType.simpleString()
    rows = docs.select(F.col(row_id).alias("id"), held_out(F.col(row_id)).alias("held_out"), F.col(text).alias("text"))
    out = rows.mapInArrow(predicted(langs, logs), f"id {kind}, held_out boolean, {FOUND}")
    return out.withColumnRenamed("id", row_id)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in no known language (no text, no letters) are rejected.

    If nothing is labelled, nothing is known and all are. Repeated rows and null ids stay like any; an empty
    table gives no rows; all columns are kept as they are.
    """
    langs, logs = fit(docs.filter(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    known = kept(langs, logs, docs.columns.index("text"))
    return docs.mapInArrow(known, docs.schema)


def kept(langs: list[str], logs: np.ndarray, at: int):
    """Rows of documents whose language is known."""
    predict = predicted(langs, logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = pa.nulls(b.num_rows)
            got = next(predict(iter([pa.RecordBatch.from_arrays([none, none, b.column(at)], names=["id", "held_out", "text"])])))
            yield b.filter(pa.array([x != UNKNOWN for x in got.column("lang_pred").to_pylist()]))

    return run


ORACLE: dict[str, str] = {}
QUERIES = {"op8_language_id": op8_language_id}
