"""Each operator against brute force, with nulls, blanks, long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import ann, chat_format, exact_dedup, langid, mixing, near_dup, packing, pii, substring, warc
from topicloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, id string, n int, digest string, rank int, hash string, key string"
rng = random.Random(5)
VOCAB = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def near(text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(VOCAB)
    return " ".join(words)


BASE = prose(200)
TEXTS = [
    (1, BASE), (2, None), (3, ""), (4, " \t\n"), (5, BASE), (6, BASE.replace(" ", " \n ")), (7, near(BASE, 4)), (8, near(BASE, 30)), (9, "one two three"),
    (10, "one two three"), (11, prose(5000)), (12, prose(30) + " " + " ".join(BASE.split()[50:90])), (13, "é ñ 中文   x"), (14, "A b C d E f"), (15, "a B c D e F"),
    (16, " ".join(["same"] * 40)), (17, " ".join(["same"] * 60)), (None, BASE), (None, None), (20, prose(100)), (20, prose(50)), (21, "tie"), (21, "tie"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][k % 2], ["a", "b", None, "c"][k % 4] if k % 3 else "a", "x", 1, "d", 2, "h", "k") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def path_of(df, tmp_path):
    df.write.mode("overwrite").parquet(path := f"file://{tmp_path}/t.parquet")
    return path


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, tmp_path, weak):
    norm = lambda t: re.sub("[ \t\n\v\f\r]+", " ", t or "")
    digest = (lambda c: F.encode(F.substring(c, 1, 1), "UTF-8")) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(spark, path_of(docs, tmp_path), digest=digest).collect()
    assert len(got) == len(TEXTS) and sum(r["kept"] for r in got) == len({norm(t) for _, t in TEXTS})
    want = sorted((i if i is not None else -1, min((j for j, u in TEXTS if norm(u) == norm(t) and j is not None), default=-1), sum(norm(u) == norm(t) for _, u in TEXTS)) for i, t in TEXTS)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"] if r["keep_id"] is not None else -1, r["group_size"]) for r in got) == want


def test_exact_dedup_batches_and_empty(spark, docs, none, tmp_path):
    path = path_of(docs, tmp_path)
    a = exact_dedup.exact_dedup(spark, path, batch_bytes="1")
    b = exact_dedup.exact_dedup(spark, path)
    assert sorted(map(str, a.drop("at").collect())) == sorted(map(str, b.drop("at").collect()))
    assert exact_dedup.exact_dedup(spark, path_of(none, tmp_path / "e")).count() == 0
    assert exact_dedup.stage(spark, docs, "").count() == sum(r["kept"] for r in b.collect())


def test_chat_format(spark):
    texts = ["", None, "</s>", "<\\s>", "<\\\\s>[INST]", "[\\+]", "a[+]b", "\\", "é\n中", "[/INST]<s>", "<", "["]
    rows = [(k, t, r, texts[(7 * k + t) % len(texts)], "x", t) for k in range(12) for t, r in enumerate(["user", "user", "assistant", "assistant", "sys<s>\n%0A", None, "assistant"])]
    rows += [(None, 0, "user", "x", "y", 1), (50, None, "assistant", "late", "y", 1), (50, None, "assistant", "late", "y", 1), (60, 1, "user", "q", "y", 1)]
    rows += [(70, t, ["user", "assistant"][t % 2], "long " * 20, "y", 1) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, k string, x int")
    out = chat_format.chat_format(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", "loss_mask", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv]["loss"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat_format.chat_format(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_format.Template(controls=("<s>", "<s>x"))


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [r.asDict() for r in packing.pack(docs, length=256, with_ids=True, buffer=7).collect()]
    for r in got:
        r["ids"] = np.frombuffer(r["ids"], "<u2").tolist()
    ids = sorted(tuple(tk.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in TEXTS)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 256
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    total = sum(map(len, ids))
    assert sum(r["length"] for r in got) == total and len(by) <= 1.2 * total / 256 + 3
    whole = sorted(tuple(r["ids"]) for r in got if r["start"] == 0 and r["length"] < 256)
    assert whole == [x for x in ids if len(x) < 256]
    assert packing.pack(none).count() == 0
    assert packing.best_fit([3, 5, 2, 4], 7) == [[1, 2], [3, 0]]


def test_packing_encodes_as_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk, few = Tokenizer.from_file(path), packing.WordEncoder(path, 60)  # forgets all the time
    bits = ["<|endoftext|>", "<|startoftext|>", "<|", "abc", "Éa", "don't", "x,", "ß", " ", "\n", "\u00a0", "1", "İ", "ΑΣ", "中", "\u0301", "'s", ".", " Abc abc, ABC. "]
    for k in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14))) + prose(k % 30)
        assert few.encode(text.encode()).tolist() == tk.encode(text, add_special_tokens=False).ids


def test_packing_asks_the_model_for_letters_and_marks():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk, enc, slow = Tokenizer.from_file(path), packing.WordEncoder(path, 500), packing.WordEncoder(path, 500)
    slow.direct = False  # as for a tokenizer that is not known
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x180)]]
    bits = ["abc", "Éa", "ſß", "don't", "'s", "$$$", ",%%%", "!!", "_", "<|endoftext|>", "1", "\u0301", "\u00a0", " ", " \n", "\0", "中"]
    texts = ["", " ", *letters, *(x + "e&&&" for x in letters), *("".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(600))]
    want = [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode_all([t.encode() for t in texts])] == [x.tolist() for x in slow.encode_all([t.encode() for t in texts])] == want
    assert enc.encode_all([]) == [] and [len(x) for x in enc.encode_all([b"", b" "])] == [0, 0]
    asked, text = [], "Zzqa zzqa!? éZzq$$$ zzqa"
    enc.encode_batch = lambda batch, **k: asked.extend(batch) or tk.encode_batch(batch, **k)
    assert enc.encode(text.encode()).tolist() == tk.encode(text).ids and asked == []


def test_packing_numbers_words_once_where_marks_stand_alone_too():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    for text in ("abc. . a1", "zzb2", "q7", "a1", "abc$$$ $$$ a3", "b4", "a3 . $$$ abc."):
        assert enc.encode(text.encode()).tolist() == tk.encode(text).ids


@pytest.mark.parametrize(("parts", "waste"), [(1, 0.01), (8, 0.01), (70, 0.02)])
def test_packing_fills_sequences_at_any_depth(spark, parts, waste):
    """1, 2 and 4 levels, against the least number of sequences that the tokens need."""
    df = spark.createDataFrame([(i, prose(rng.choice([3, 10, 40, 90, 150]))) for i in range(3000)], "doc_id long, text string").repartition(parts)
    got = packing.pack(df, length=512).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert got[1] <= (1 + waste) * -(-got[0] // 512) + 1


def test_mixing(docs, none):
    for whole in (False, True):
        rows = mixing.mix(docs, whole=whole).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        sizes = {r["source"]: r["source_size"] for r in rows}
        goal = {r["source"]: r["target"] for r in rows}
        assert sum(goal.values()) == pytest.approx(sum(sizes.values())) and all(goal[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
        if not whole:
            assert all(sum(r["taken"] for r in rows if r["source"] == s) == int(goal[s] + 1e-6) for s in sizes)
        again = {(r["doc_id"], r["size"], r["source"], r["taken"], r["position"]) for r in mixing.mix(docs, whole=whole).collect()}
        assert again == {(r["doc_id"], r["size"], r["source"], r["taken"], r["position"]) for r in rows}
        assert all(0 <= p <= 1 for r in rows for p in r["positions"])
    assert mixing.mix(none).count() == 0
    assert mixing.integral(mixing.SCHEDULES[0]) == 5


def test_substring(spark, docs, none, monkeypatch):
    window = 13
    words = lambda t: (t or "").encode().split()
    first = {}
    for i, t in TEXTS:
        if i is not None:
            for k in range(len(words(t)) - window + 1):
                g = tuple(words(t)[k : k + window])
                first[g] = min(first.get(g, i), i)
    want = []
    for i, t in TEXTS:
        ws = words(t)
        gone = {k + j for k in range(len(ws) - window + 1) for j in range(window) if i is not None and first[tuple(ws[k : k + window])] < i}
        want.append((i if i is not None else -1, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    def removed(**how):
        got = substring.substring_dedup(docs, **how).collect()
        return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept"]) for r in got)

    assert removed() == sorted(want) and removed(crowd=5) == sorted(want)
    monkeypatch.setattr(substring, "BATCH_BYTES", 300)  # repeats meet in groups, crowded ones by levels
    assert removed() == sorted(want) and removed(crowd=5) == sorted(want)
    assert substring.substring_dedup(none).count() == 0


def test_substring_sorts_suffixes():
    words = [rng.choice("abc") for _ in range(400)]
    ids = substring.Ids().of(words)
    for window in (1, 2, 3, 4, 5, 9, 13):
        at = np.arange(0, 400 - window + 1, 2)
        node = substring.nodes(ids, at, window)
        want = {w: n for n, w in enumerate(sorted({tuple(ids[i : i + window].tolist()) for i in at}))}
        assert [want[tuple(ids[i : i + window].tolist())] for i in at] == node.tolist()
    big = ids + (np.arange(400) == 399) * (1 << 30)  # too many words for ranks of three parts
    assert substring.nodes(big, np.arange(380), 13).tolist() == substring.nodes(ids, np.arange(380), 13).tolist()


def test_substring_hashes_words():
    text = "one two\tone \n two" + " x" * 40_000 + " " + "y" * 200_000 + " one " + "y" * 199_999 + "z"
    h, start, end = substring.hashed_words(np.frombuffer(text.encode(), np.uint8))
    words = [text[a:b] for a, b in zip(start, end)]
    assert words == text.split() and len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))


def test_substring_hot_phrase_and_levels(spark, monkeypatch):
    """A phrase in all documents, among changing neighbours: its prefix is lengthened, no group grows, nothing is lost."""
    line = " ".join(f"common{i}" for i in range(9))
    long = " ".join(f"passage{i}" for i in range(20))
    texts = [f"{prose(9)} {line} {prose(9)} e{i} {long if i % 3 == 0 else prose(4)}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substring, "BATCH_BYTES", 2000)
    whole = sorted(map(tuple, substring.substring_dedup(df).collect()))
    assert {r[0] for r in whole if r[2]} == set(range(3, 200, 3)) and {r[2] for r in whole if r[2]} == {20}
    monkeypatch.setattr(substring, "SALT_FILES", 1)
    monkeypatch.setattr(substring, "GROUP", 50)
    assert sorted(map(tuple, substring.substring_dedup(df, crowd=30).collect())) == whole


@pytest.mark.parametrize("k", [4, 5])
def test_near_dup(docs, none, k):
    def shingles(t):
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())

    sets = [(i, shingles(t)) for i, t in TEXTS if i is not None]
    root = {i: i for i, _ in sets}
    for _ in range(5):
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = [r for r in near_dup.near_dup(docs, k=k).collect() if r["doc_id"] is not None]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted((i, len(s), root[i], root[i] == i) for i, s in sets)
    assert near_dup.near_dup(none).count() == 0


def test_near_dup_large_buckets_and_blocks(spark, monkeypatch):
    text = prose(150)
    rows = [(i, near(text, i % 6)) for i in range(120)] + [(200 + i, prose(80)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, near_dup.near_dup(df, k=4).collect()))
    monkeypatch.setattr(near_dup, "PART", 10)
    monkeypatch.setattr(near_dup, "BLOCK", 25)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, near_dup.near_dup(df, k=4).collect())) == whole


def test_near_dup_keeps_links_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 (sets of 200 runs): none may be lost."""
    rows = []
    for i in range(150):
        words = [f"v{i}_{j}" for j in range(203)]
        n = 16 + i % 6  # of 203 words the last n differ: 200 - n of 200 + n runs are shared
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 203 - n] + [f"u{i}_{j}" for j in range(n)]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_dup(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(150))


def test_near_dup_stage_judges_rows_of_one_id_apart(spark):
    lone = prose(100)
    rows = [(1, BASE, "x"), (2, near(BASE, 2), "x"), (2, lone, "x"), (3, None, "x"), (None, BASE, "x"), (4, "", "x"), (5, near(BASE, 1), "x"), (1, prose(90), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    got = near_dup.stage(spark, df.withColumnRenamed("mark", "source"), "")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumnRenamed("mark", "source").filter("doc_id IS NULL OR doc_id IN (1, 3, 4) OR length(text) = " + str(len(lone))).collect()))


STAGES = [exact_dedup.stage, langid.stage, near_dup.stage, mixing.stage, packing.stage]


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.__module__.rpartition(".")[2])
def test_stages_on_empty_and_odd_tables(spark, docs, none, stage):
    """Empty tables, nulls everywhere, and columns named like the stages' own."""
    odd = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("at"), F.lit(1).alias("taken"), F.lit("k").alias("component_id"))
    assert stage(spark, none, "").count() == 0
    got = stage(spark, odd, "")
    assert got.count() > 0 and (stage is packing.stage or got.columns == odd.columns)


def test_mixing_splits_crowded_buckets(spark):
    rows = [(None if i % 3 else i, "w " * (1 + i % 4), "ab"[i % 2] if i % 7 else None) for i in range(3000)]
    rows += [(7, "x y", "a")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for size in (5, 40, 500_000):
        found = mixing.mix(docs, per_bucket=size).drop("positions").collect()
        got[size] = sorted(map(tuple, found), key=repr)
    assert len(got[5]) == len(rows)
    assert got[5] == got[40] == got[500_000]


def test_mix_stage_takes_equal_rows_apart(spark):
    rows = [(1, "a b c d", None, "s", 7)] * 3 + [(2, prose(8), None, "t", 9)]
    got = mixing.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), whole=True).groupBy("doc_id").agg(F.sum("copies").alias("copies")).collect()}
    assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("small", [0, None])
def test_components(spark, small):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)] + [(500, x) for x in range(501, 560)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), small=small).collect()))
    assert components(spark.createDataFrame(edges[:0], "u long, v long"), small=small).count() == 0
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 500: 500, **{x: 500 for x in range(501, 560)}}


def test_warc(spark, tmp_path, monkeypatch):
    page = "<p>" + "ö" * 80
    rows = [(1, "http://a/ü\r\nX: y", page, "f"), (2, None, page, "f"), (3, "u", "short", "f"), (4, "u", "short", "f"), (5, "u", None, "f"), (6, "u", "", "f"), (2, "u", page, "f"), (None, "u", page, "f"), (9, "u", "z" * 300_000, "f")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    index = warc.write_archives(df, f"file://{tmp_path}/w", most=400)
    got = warc.read_records(index, payloads=True).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got) == sorted(
        [(1, 163, "response", 0), (2, 163, "revisit", 1), (2, 163, "revisit", 1), (0, 163, "revisit", 1), (3, 5, "response", 0), (4, 5, "response", 0), (5, 0, "response", 0), (6, 0, "response", 0), (9, 300_000, "response", 0)]
    )
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["payload"] is not None)
    again = warc.index_archives(spark, index.select("file").distinct())
    assert sorted(map(str, again.collect())) == sorted(map(str, index.collect()))
    monkeypatch.setattr(warc, "STRETCH", 100)
    assert warc.read_records(index).select(F.spark_partition_id()).distinct().count() > 2  # a large archive is read by many tasks
    picked = warc.read_records(index.filter("page_id = 9")).collect()
    assert [r["payload_bytes"] for r in picked] == [300_000]
    assert warc.read_records(warc.write_archives(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_pii(spark, none):
    good, bad = "4111 1111 1111 1111", "4111 1111 1111 1112"
    texts = [None, "", f"mail a.b+c@x-y.co.uk, ip 10.0.0.255 or 1.2.3.456 card {good}; {bad} tel +1 (555) 010-9999.", "é a@b.c_x@d.e 1.2.3.4.5.6.7.8 ++12 +", "9" * 5000 + "@" + "a" * 5000, "x@y z@w.v " * 50]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) < 256 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: m in (good,)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for r in pii.sanitise(df, rewrite=True).collect():
        t = texts[r["doc_id"]] or ""
        want = sorted((m.start(), k, m.end(), m.group()) for k, (p, ok) in enumerate(kinds.values()) for m in (re.finditer(p, t) if len(t) < 9000 else ()) if ok(m.group()))
        assert [tuple(s) for s in r["spans"]] == want
        if r["doc_id"] == 2:
            assert r["clean"] == f"mail [email], ip [ip] or 1.2.3.456 card [card]; {bad} tel [phone]."
    assert pii.sanitise(none).count() == 0


def test_pii_revealing_terms(spark):
    rows = [(i, f"{prose(30)} zanzibar {prose(3)} owner@secret.org {prose(i % 5)}") for i in range(30)] + [(100 + i, prose(60)) for i in range(300)]
    for most in (10, 0):
        out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_terms=most).collect()
        terms = {s["value"] for r in out for s in r["spans"] if s["kind"] == 4}
        assert terms == {"zanzibar"}


def test_pii_copies_do_not_hide_a_term(spark):
    held = [f"{prose(30)} zanzibar owner@secret.org {prose(3)}" for _ in range(8)]
    rows = list(enumerate(held + [held[0]] * 200 + [prose(60) for _ in range(300)]))
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), min_bits=30.0).collect()
    assert {r["doc_id"] for r in out if "zanzibar" in [s["value"] for s in r["spans"] if s["kind"] == 4]} == set(range(208))


def test_pii_rare_entities_are_judged_by_evidence(spark):
    held = [f"{prose(30)} {t} {e}@secret.org {prose(3)}" for t, e, k in (("zanzibar", "two", 2), ("timbuktu", "three", 3), ("samarkand", "one", 1)) for _ in range(k)]
    df = spark.createDataFrame(list(enumerate(held + [prose(60) for _ in range(500)])), "doc_id long, text string")
    terms = lambda bits: {s["value"] for r in pii.sanitise(df, min_bits=bits).collect() for s in r["spans"] if s["kind"] == 4}
    assert terms(15.0) == {"zanzibar", "timbuktu"} and terms(20.0) == {"timbuktu"}


def test_langid(spark, none):
    words = {"xa": ["bada", "gabu", "dabo", "bagu"], "yb": ["elixi", "ixele", "lexil", "eexil"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, lang) for i in range(200) for lang in [["xa", "yb"][i % 2]]]
    rows += [(900, None, "xa", "q"), (901, "", "xa", "q"), (902, "123 !?", "xa", "q"), (903, "bada " * 30 + "elixi " * 10, None, "q"), (904, "gabu " * 300_000, None, "q"), (None, "dabo bagu", None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r["doc_id"]: r for r in langid.language(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:200]) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "xa" and 0.6 < got[903]["score"] < 0.9 and got[904]["lang_pred"] == "xa"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert langid.language(none).count() == 0
    assert {r["lang_pred"] for r in langid.language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_langid_mixtures_against_plain_em():
    """Greedy growth of the language set by BIC, document by document; a fourth language is no special case."""
    gen = np.random.default_rng(8)

    def plain(like):
        def em(allowed, steps):
            part = np.where(allowed, 1.0, 0.0) / allowed.sum()
            for _ in range(steps):
                joint = like * part
                part = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            return part, np.log((like * part).sum(axis=1)).sum()

        full, best, out = em(np.ones(like.shape[1], bool), 10)[0], np.inf, None
        order = np.argsort(-full, kind="stable")
        for m in range(like.shape[1]):
            part, total = em(np.isin(np.arange(like.shape[1]), order[: m + 1]), 10 if m else 1)
            cost = -2 * total + m * np.log(len(like) + 1)
            if cost >= best:
                break
            best, out = cost, part
        return out

    docs = []
    for langs in ([0], [1, 2], [0, 1, 2, 3], [4], [0, 1, 2, 3, 4], [2, 3]):
        like = np.full((60, 5), 0.01) + gen.random((60, 5)) / 50
        like[np.arange(60), [langs[i % len(langs)] for i in range(60)]] = 1.0
        docs.append(like)
    got = langid.inferred(np.concatenate(docs), np.arange(6) * 60)
    assert np.allclose(got, [plain(x) for x in docs], atol=1e-9)
    assert ((got > 0).sum(axis=1) == [1, 2, 4, 1, 5, 2]).all()


def test_langid_words_are_never_cut(monkeypatch):
    table = np.random.default_rng(2).random((langid.TABLE, 3))
    text = "Ab cd, efghijklmnopqrstuvwxyz 12 " + "q" * 50 + " x"
    whole = langid.word_logs(text, table)
    for chunk in (1, 3, 7, 20):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.allclose(langid.word_logs(text, table), whole)
    assert len(whole) == 5


def test_nearest_recall_at_the_defaults(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {}
    for r in ann.op10_nearest(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.select("vec_id", "embedding").collect()}
    hits = total = 0
    for q in (i for i in x if i % 20 == 0):
        want = sorted((-float(np.dot(x[q], v)), i) for i, v in x.items() if i != q)[:20]
        assert all(s == pytest.approx(float(np.dot(x[q], x[i])), abs=1e-12) for i, s in got[q].items())
        hits, total = hits + len({i for _, i in want} & set(got[q])), total + 20
    assert hits >= 0.9 * total


def test_nearest(spark):
    gen = np.random.default_rng(3)
    x = gen.standard_normal((400, 8)).round(3)
    x[50:90] = x[0]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(1000, None, "q"), (1020, [0.0] * 8, "q"), (1040, [1.0] * 7 + [float("nan")], "q"), (1060, [None] + [1.0] * 7, "q"), (1080, [1.0], "q"), (None, [1.0] * 8, "q"), (20, x[20].tolist(), "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query string")
    got = ann.nearest(df, "vec_id % 20 = 0", k=5, probes=400).collect()
    hits, total = 0, 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(400), -s.round(12))) if i != q][:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12) for r in mine)
        hits, total = hits + len(set(want) & {r["vec_id"] for r in mine}), total + 5
    assert hits >= 0.9 * total and {r["query_id"] for r in got} == set(range(0, 400, 20))
    assert ann.nearest(df.limit(0), "true").count() == 0
    assert ann.nearest(df.filter("vec_id < 3"), "true").count() == 6


def test_nearest_ties_go_to_the_smaller_id(spark):
    x = np.array([[float(i in c) for i in range(10)] for c in itertools.combinations(range(10), 3)])
    x = x[np.random.default_rng(4).permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, "vec_id < 20", k=5, width=100.0, probes=400).collect()
    for q in range(20):
        want = [i for i in np.lexsort((np.arange(len(x)), -(x @ x[q]))) if i != q][:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    rows = docs.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")
    path_of(rows, tmp_path)
    rows.write.parquet(f"file://{tmp_path}/documents.parquet")
    step = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    norm = lambda t: re.sub("[ \t\n\v\f\r]+", " ", t or "")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(f"file://{tmp_path}/{k}")
        before, step = step, spark.read.parquet(f"file://{tmp_path}/{k}")
        if name != "best_fit_packing":
            assert step.columns == rows.columns
        if name == "language_id":
            assert sorted(r["text"] for r in step.collect()) == sorted(t for _, t in TEXTS if t and any(c.isalpha() for c in t))
        if name == "exact_dedup":
            assert sorted(norm(r["text"]) for r in step.collect()) == sorted({norm(r["text"]) for r in before.collect()})
    assert step.agg(F.sum("length")).first()[0] > 0 and corpus_pipeline.run(spark, f"file://{tmp_path}").count() == step.count()
