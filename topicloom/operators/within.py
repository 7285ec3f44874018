"""Work that stays within a document: words travel as Arrow lists, and whole batches are counted by numpy without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are counted at once, some 100 bytes of temporary arrays each; a document is never cut.
AT_ONCE = 300_000


def by_document(rows: DataFrame, ids: DataFrame, key: str, **lists: Column) -> DataFrame:
    """``key`` and, under each name, its lists: one per row of that id. Only rows whose id repeats in ``ids`` are shuffled."""
    again = ids.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("_again"))
    one = lambda r: r.select(key, *[F.array(c).alias(n) for n, c in lists.items()])
    if again.isEmpty():
        return one(rows)
    same = F.col(key).eqNullSafe(F.col("_again"))
    many = rows.join(again, same, "left_semi").select(key, *[c.alias(n) for n, c in lists.items()])
    return one(rows.join(again, same, "left_anti")).unionByName(many.groupBy(key).agg(*[F.collect_list(n).alias(n) for n in lists]))


class Words:
    """The words of some documents in a row: ``code`` into ``vocab``, and the number of its text and document."""

    def __init__(self, lists: pa.Array) -> None:
        texts = lists.flatten()
        self.text = pc.list_parent_indices(texts).to_numpy()
        self.doc = pc.list_parent_indices(lists).to_numpy()[self.text].astype(np.int64)
        coded = pc.dictionary_encode(texts.flatten())
        self.vocab, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def order(self) -> np.ndarray:
        """The place of each word of the vocabulary by its bytes."""
        place = np.empty(len(self.vocab), np.int64)
        place[pc.array_sort_indices(self.vocab).to_numpy()] = np.arange(len(self.vocab))
        return place


def batches(run: Callable[[pa.RecordBatch], pa.RecordBatch], *lists: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``run`` over runs of documents that hold about ``AT_ONCE`` words in the columns ``lists``."""

    def over(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            held = [(c, pc.list_value_length(c.flatten()).to_numpy(zero_copy_only=False)) for c in map(batch.column, lists)]
            ends = sum(np.bincount(pc.list_parent_indices(c).to_numpy(), n, batch.num_rows) for c, n in held).cumsum()
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
                if (out := run(pa.concat_batches([batch.slice(at, to - at)]))).num_rows:
                    yield out
                at = to

    return over


def best(doc: np.ndarray, score: np.ndarray, most: int, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the ``most`` least scores of each document, in order, and their ranks from 0; equal scores by ``ties``."""
    rows = np.argsort(doc, kind="stable")
    edges = np.flatnonzero(np.diff(doc[rows], prepend=-1, append=-1)) if len(rows) else np.zeros(0, int)
    keep = np.ones(len(rows), bool)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > most:  # rows that tie with the last one wait for the sort
            s = score[rows[a:b]]
            keep[a:b] = s <= np.partition(s, most - 1)[most - 1]
    rows = rows[keep]
    rows = rows[np.lexsort((*[t[rows] for t in reversed(ties)], score[rows], doc[rows]))]
    starts = np.flatnonzero(np.diff(doc[rows], prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
    return rows[rank < most], rank[rank < most]


def phrases(vocab: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """The words ``first``, joined to ``second`` where that is not -1."""
    one = vocab.take(pa.array(first))
    two = vocab.take(pa.array(second, mask=second < 0))
    return pc.coalesce(pc.binary_join_element_wise(one, two, " "), one)


class Terms:
    """Per document and term of marked words (see ``marked``): counts, sentences, neighbours ``window`` words off."""

    def __init__(self, words: Words, window: int = 1) -> None:
        head = pc.utf8_slice_codeunits(words.vocab, 0, 1)
        ends, stops = (pc.is_in(head, pa.array(list(x), head.type)).to_numpy(zero_copy_only=False)[words.code] for x in (".!?\n", ",;:()"))
        text, size = words.text, len(words.vocab)
        run = np.cumsum(ends)
        firsts = np.flatnonzero(np.diff(text, prepend=-1))
        run -= np.repeat(run[firsts] - ends[firsts], np.diff(firsts, append=len(text)))
        word = np.flatnonzero(~(ends | stops))
        self.at, self.code, doc, text, sent = word, words.code[word], words.doc[word], text[word], run[word]
        self.text, self.size = text, size
        self.keys, self.of = np.unique(doc * size + self.code, return_inverse=True)
        self.doc, self.term = self.keys // size, self.keys % size
        n = len(self.keys)
        self.tf = np.bincount(self.of, minlength=n)
        spans = int(sent.max(initial=0)) + 1
        seen = np.unique(self.of * spans + sent)
        self.sents = np.bincount(seen // spans, minlength=n)
        self.first_sent = seen[np.flatnonzero(np.diff(seen // spans, prepend=-1))] % spans
        near = np.flatnonzero((text[window:] == text[:-window]) & (sent[window:] == sent[:-window]))
        kinds = lambda a, b: np.bincount(np.unique(self.of[a] * size + self.code[b]) // size, minlength=n)
        self.n_left, self.left_kinds = np.bincount(self.of[near + window], minlength=n), kinds(near + window, near)
        self.n_right, self.right_kinds = np.bincount(self.of[near], minlength=n), kinds(near, near + window)

    def weights(self, stop: np.ndarray, use_position: bool) -> np.ndarray:
        """Lower is better; nan of stop words."""
        tf, docs, ok = self.tf, int(self.doc.max(initial=-1)) + 1, ~stop[self.term]
        top, spread = np.zeros(docs), np.zeros(docs)
        np.maximum.at(top, self.doc, tf)
        np.maximum.at(spread, self.doc, self.sents)
        n = np.maximum(np.bincount(self.doc[ok], minlength=docs), 1)
        mean = np.bincount(self.doc[ok], tf[ok], docs) / n
        std = np.sqrt(np.bincount(self.doc[ok], (tf[ok] - mean[self.doc[ok]]) ** 2, docs) / n)
        ratio = lambda kinds, of: np.where(of > 0, kinds / np.maximum(of, 1), 0.0)
        rel = 1 + (ratio(self.left_kinds, self.n_left) + ratio(self.right_kinds, self.n_right)) * (tf / top[self.doc])
        freq = tf / (mean[self.doc] + std[self.doc] + 1e-12)
        place = np.log(np.log(3.0 + self.first_sent)) if use_position else 1.0
        weight = rel * place / (freq / rel + (self.sents / spread[self.doc]) / rel)  # texts are lower-cased: the case feature is 0
        return np.where(ok, weight, np.nan)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of two words without a mark between them: the first's term, the second's, and how often."""
        i = np.flatnonzero((np.diff(self.at) == 1) & (self.text[1:] == self.text[:-1]))
        key, n = np.unique(self.of[i] * self.size + self.code[i + 1], return_counts=True)
        first = key // self.size
        return first, np.searchsorted(self.keys, self.doc[first] * self.size + key % self.size), n


def marked(text: Column) -> Column:
    """Words of letters and digits, and between them runs of marks: those that end sentences, and others that end phrases."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[.!?\n]+|[,;:()]+)"), F.lit(1))
