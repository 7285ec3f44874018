"""Best-fit packing of documents into fixed-length sequences by hierarchical residual packing.

Every partition tokenises its documents and packs the pieces locally, longest first, each into the bin
with the least room that still takes it. Nearly full bins are done. The others become items themselves and
go to an eighth as many partitions, where they are packed again, and so on up a tree; each level asks for
a little less fill, so that what climbs shrinks and the root sees few bins (of bins half full or less, best
fit leaves one a task). Levels are written tables, so a lost executor costs one task. A task that has
``buffer`` pieces packs them and goes on; what is not nearly full climbs like the rest.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, settle

TOKENIZER = "word_bpe_49k.json"
#: Fill (as a part of the length) from which a bin is done, by level; the last holds from there on.
FILLS = (0.98, 0.9, 0.8, 0.65, 0.5)
FAN_IN = 8
#: Words that a Python worker remembers at most, some 150 bytes each.
WORDS = 800_000
#: Bytes of text that are looked up together; a longer text goes alone.
CHUNK = 1 << 20
#: Marks that the tokenizer parts from the letters before them, a run of them as one.
MARKS = string.punctuation.encode()
#: By byte: not white space, as ``bytes.split`` has it.
SOLID = ~np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Letters that neither composition nor lower-casing turns into more than a letter.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]{1,999}").fullmatch
#: What parts and changes texts in the tokenizer of the contract, as ``__getstate__`` tells it, and its special tokens.
#: It hands lower-case Latin letters and runs of marks to its model unchanged but for BYTES.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SPECIAL = {"<|startoftext|>", "<|endoftext|>"}
#: The letter that stands for each byte in a byte-level vocabulary.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = dict(zip([*PRINTED, *sorted(set(range(256)) - set(PRINTED))], map(chr, [*PRINTED, *range(256, 324)]), strict=True))


def strung(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` of these begins and sizes, in turn."""
    n = size.astype(np.int64)
    ends = np.cumsum(n)
    place = np.repeat(begin - (ends - n), n)
    place += np.arange(len(place))
    return flat[place]


def parted(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts, each word's number among them, and the number of words up to each text's end."""
    solid = SOLID[body := np.frombuffer(b" ".join(texts), np.uint8)]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(body[solid])]).dictionary_encode()
    until = np.cumsum([len(t) + 1 for t in texts])
    _, ends, held = words.dictionary.buffers()
    ends, held = np.frombuffer(ends or b"\0" * 4, np.int32)[: len(words.dictionary) + 1].tolist(), (held or b"") and held.to_pybytes()
    return [held[i:j] for i, j in pairwise(ends)], words.indices.to_numpy(), np.searchsorted(begin, until)


class WordEncoder:
    """Ids of whole texts, word by word, with a bounded memory of words.

    The tokenizer never joins what white space parts, so the ids of a text are those of its words in turn; the
    strings of its special tokens hold no white space. When the memory is full, what was never met again since
    it was learned is forgotten.
    """

    def __init__(self, path: str, words: int = WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # the fast one keeps no offsets
        self.most, self.model = words, self.tokenizer.model
        state = lambda x: x and json.loads(x.__getstate__())
        #: Whether the model may be asked for words of letters or of marks without what comes before it.
        self.direct = (
            (state(self.tokenizer.normalizer), state(self.tokenizer.pre_tokenizer))
            == (NORMALIZER, {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]})
            and {str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()} <= SPECIAL
            and self.tokenizer.truncation is self.tokenizer.padding is None
        )
        #: Whether an id ends a word; the vocabulary writes that as a suffix.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {b"": 0}
        self.flat = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.begin, self.size, self.again = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)
        self.used = 0

    def tokenized(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.encode_batch([t.decode() for t in texts], add_special_tokens=False)]

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of known words, by number, in turn."""
        return strung(self.flat, self.begin[at], self.size[at])

    def put(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, used = len(self.index), self.used + len(ids)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(words) > len(self.begin):
            self.begin, self.size, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.again))
        self.flat[self.used : used] = ids
        self.begin[at : at + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + len(words)] = sizes
        self.used = used
        self.index.update(zip(words, range(at, at + len(words)), strict=True))

    def put_lists(self, words: list[bytes], ids: list[list[int]]) -> None:
        self.put(words, np.array([x for own in ids for x in own], self.flat.dtype), np.fromiter(map(len, ids), np.int64, len(ids)))

    def shrink(self) -> None:
        """Forget words that were not met again since the memory was half full; of the others, those learned first
        stay, half the bound at most."""
        keep = np.flatnonzero(self.again[: len(self.index)])[: self.most // 2]
        words = list(self.index)
        held, ids, sizes = [words[i] for i in keep.tolist()], self.gather(keep), self.size[keep]
        self.clear()
        if len(ids) <= 10 * self.most:
            self.put(held, ids, sizes)

    def learn(self, new: list[bytes]) -> None:
        """Ids of new words. Latin letters and marks behind them are looked up in parts."""
        cores: list[bytes] = []
        cut: list[bytes] = []  # letters and marks of each of these in turn
        whole: list[bytes] = []
        other: list[bytes] = []
        for w in new:
            core = w.rstrip(MARKS) or w  # marks alone are a part themselves: no word may be put twice
            mark = w[len(core) :]
            if core.isalpha():  # of bytes: ASCII letters only
                core = core.lower()
            elif not core.strip(MARKS):
                pass
            elif core.isascii() or not LATIN(letters := core.decode()):
                other.append(w)
                continue
            else:
                core = letters.lower().encode()
            cores.append(core)
            if core != w:
                whole.append(w)
                cut += (core, mark)
        todo = [x for x in dict.fromkeys(cores + cut[1::2]) if x not in self.index]
        for k in range(0, len(todo), 4096):
            part = todo[k : k + 4096]
            if self.direct:
                flat: list[int] = []
                ends_at: list[int] = []
                for x in part:
                    flat += [t.id for t in self.model.tokenize(x.decode() if x.isascii() else x.decode("latin-1").translate(BYTES))]
                    ends_at.append(len(flat))
                self.put(part, np.array(flat, self.flat.dtype), np.diff(ends_at, prepend=0))
                continue
            ids = np.array(self.tokenized([b" ".join(part)])[0], self.flat.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                self.put(part, ids, np.diff(ends, prepend=0))
            else:  # a tokenizer that doesn't end each word with a mark of its own
                self.put_lists(part, self.tokenized(part))
        if whole:  # no mark is the empty word, number 0
            parts = np.fromiter(map(self.index.__getitem__, cut), np.int64, len(cut))
            self.put(whole, self.gather(parts), self.size[parts].reshape(-1, 2).sum(axis=1))
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            self.put_lists(part, self.tokenized(part))

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. Texts are taken together so that a word is looked up once, however often they say it."""
        if not texts:
            return []
        words, codes, until = parted(texts)
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(self.index) > self.most // 2:
            self.again[at[at >= 0]] = True
        if len(missing):
            if len(self.index) > self.most or self.used > 20 * self.most:
                self.shrink()
                at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
                missing = np.flatnonzero(at < 0)
            new = [words[i] for i in missing.tolist()]
            self.learn(new)
            at[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        size = self.size[at]
        own = size[codes]
        ids = strung(self.gather(at), (np.cumsum(size) - size)[codes], own)
        return np.split(ids, np.concatenate([[0], np.cumsum(own)])[until[:-1]])

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all([text])[0].astype(np.uint32)


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, words: int) -> WordEncoder:
    """One per Python worker."""
    if (path, words) not in _encoders:
        _encoders[path, words] = WordEncoder(path, words)
    return _encoders[path, words]


def encoded(texts: pa.Array, memory: WordEncoder) -> Iterator[np.ndarray]:
    """The ids of each text (null: none), looked up by chunks."""
    held, size = [], 0
    for body in texts:
        text = body.as_py() or b""
        if held and size + len(text) > CHUNK:
            yield from memory.encode_all(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    yield from memory.encode_all(held)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items by bin, longest first, each into the bin with the least room that takes it; ties to the latest bin."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: there is a bin with room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room[r - n].append(b)
        if r > n:
            open_ |= 1 << (r - n)
    return bins


def packed(items: list[tuple[int, list[tuple]]], capacity: int) -> Iterator[tuple[int, list[tuple]]]:
    """Bins of items. An item is (length, members); a member ends with its offset."""
    for chosen in best_fit([n for n, _ in items], capacity):
        fill, members = 0, []
        for i in chosen:
            n, own = items[i]
            members += own if not fill else [(*m[:-1], m[-1] + fill) for m in own]
            fill += n
        yield fill, members


def pack(
    docs: DataFrame,
    length: int = 4096,
    end_id: int = 1,
    tokenizer: str | None = None,
    row_id: str = "doc_id",
    text: str = "text",
    fills: tuple[float, ...] = FILLS,
    buffer: int = 200_000,
    with_ids: bool = False,
    words: int = WORDS,
) -> DataFrame:
    """One row per piece: ``<row_id>, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is its ids and ``end_id``; null or empty text is ``end_id`` alone. Only documents longer
    than ``length`` are cut, into pieces of that length, the last maybe shorter. Pieces of a sequence fill
    it from 0 without gaps. Strings of the tokenizer's special tokens in a text give those tokens. Repeated
    rows and null ids are packed like any; no rows in, no rows out; other columns are ignored. ``tokenizer``
    is the path of a tokenizer file on the executors. ``ids`` holds a piece's ids as little-endian unsigned
    numbers, of 16 bits if the vocabulary fits, else of 32; ``ids_crc32`` is always of 32-bit ones. Pieces of
    one task keep near each other: sequences that no task had to pass on are numbered by task, in its order.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    id_type = docs.schema[row_id].dataType
    member = T.StructType(
        [T.StructField("id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
        + [T.StructField("crc", T.LongType())]
        + [T.StructField("ids", T.BinaryType())] * with_ids
        + [T.StructField("offset", T.LongType())]
    )
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("fill", T.LongType()), T.StructField("members", T.ArrayType(member))])
    names = member.names
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in member.fields]

    def bins(found: Iterator[tuple[int, list[tuple]]], level: int, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        rows: list[tuple[int, int, list[tuple]]] = []

        def batch() -> pa.RecordBatch:
            flat = [m for _, _, ms in rows for m in ms]
            columns = list(zip(*flat, strict=True)) if flat else [()] * len(names)
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            offsets = pa.array(np.cumsum([0, *(len(ms) for _, _, ms in rows)]), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(offsets, struct)],
                names=["sequence_id", "fill", "members"],
            )

        for fill, members in found:
            rows.append((base + next(numbers), fill, members))
            if len(rows) >= 2000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = encoder(tokenizer, words)
        narrow, numbers, items = memory.flat.dtype.newbyteorder("<"), iter(range(1 << 32)), []
        for b in batches:
            done = []
            for who, own in zip(b.column(0).to_pylist(), encoded(b.column(1), memory), strict=True):
                ids = np.append(own.astype("<u4"), np.array([end_id], "<u4"))
                for piece, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    held = [part.astype(narrow).tobytes()] if with_ids else []
                    one = (len(part), [(who, piece, start, len(part), zlib.crc32(part.tobytes()), *held, 0)])
                    (done if len(part) == length else items).append(one)
            yield from bins(iter(done), 0, numbers)
            if len(items) >= buffer:
                yield from bins(packed(items, length), 0, numbers)
                items = []
        yield from bins(packed(items, length), 0, numbers)
        give_back()

    def node(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, items = iter(range(1 << 32)), []
            for b in batches:
                for fill, members in zip(b.column("fill").to_pylist(), b.column("members").to_pylist(), strict=True):
                    items.append((fill, [tuple(m.values()) for m in members]))
                    if len(items) >= buffer:
                        yield from bins(packed(items, length), level, numbers)
                        items = []
            yield from bins(packed(items, length), level, numbers)

        return merge

    source = docs.select(F.col(row_id).alias("id"), F.col(text).cast("binary").alias("text"))
    got = settle(source.mapInArrow(leaf, schema), "pack-leaves")
    width = 1 + int(got.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0)
    done, level = [], 0
    while width > 1:
        full = F.col("fill") >= int(length * fills[min(level, len(fills) - 1)])
        done.append(got.filter(full))
        width, level = -(-width // FAN_IN), level + 1
        got = settle(got.filter(~full).repartition(width).mapInArrow(node(level), schema), "pack-level")
    for d in done:
        got = got.unionByName(d)
    m = got.select("sequence_id", F.explode("members").alias("m"))
    ids = [F.col("m.ids")] if with_ids else []
    return m.select(
        F.col("m.id").alias(row_id), "m.piece", "m.start", "m.length", F.col("m.crc").alias("ids_crc32"), "sequence_id", "m.offset", *ids
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents, their token ids and their places in sequences.

    Nulls, blanks, repeated rows and empty tables are as in ``pack``.
    """
    return pack(docs, with_ids=True)


ORACLE: dict[str, str] = {}
QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
