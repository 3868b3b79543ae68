"""Importance resampling, hard negatives and packing against brute force, with odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import negatives, packing, resample

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [None, "", " ", "\n", "a", "A b c", "the end. " * 400, "x" * 9000, "tie tie tie", "tie tie tie", "don't  you\n\nsee 日本 é ... <|endoftext|> !?", "\tÀ la carte\r\n", "ends in space ", "of the people by the people for the people " * 30]


# ---------------------------------------------------------------- importance resampling

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = _WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def drawn(docs, target, percent=5, least=20):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    of = [(i, *features(x)) for i, x in docs]
    for _, _, f in of:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for i, n, f in of:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(spark, docs, target, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("weight", F.lit("clash")).withColumn("score", F.lit(0))
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted(map(tuple, resample.resample(d, t, **kw).collect()), key=str)


def test_resampling_matches_brute_force(spark):
    rng = random.Random(3)
    words = [rng.choice("aBcé1日") * rng.randint(1, 70) for _ in range(60)]
    docs = [(i * 7 - 300, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    docs += list(enumerate(ODD_TEXTS, 10_000)) + [(None, "a b c " * 20), docs[0], docs[0], ((1 << 63) - 1, "far away " * 15), (-(1 << 63), "far away " * 15)]
    target = [" ".join(rng.choices(words, k=20)) for _ in range(10)] + [None, ""]
    for percent in (5, 50, 100):
        assert resampled(spark, docs, target, percent=percent) == drawn(docs, target, percent)


def test_resampling_of_nothing(spark):
    assert resampled(spark, [], ["a b"]) == []
    assert resampled(spark, [(1, "a b " * 30)], []) == drawn([(1, "a b " * 30)], [])


def test_kth_key_is_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice([-5, 0, 3, 1 << 40, -(1 << 63), (1 << 63) - 1]), rng.randint(-(1 << 62), 1 << 62)) for _ in range(200)]
    df = spark.createDataFrame(rows, "score long, doc_id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 2, 57, 100, 200):
        assert tuple(resample.kth_key(df, [("score", True), ("doc_id", False)], k)) == order[k - 1]


# ---------------------------------------------------------------- hard negatives


def mined(rows, low=30, high=90):
    seen, use = set(), []
    for i, v, label in rows:
        ok = None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
        if ok and (key := (i, label, tuple(v))) not in seen:
            seen.add(key)
            use.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for a, la, va in use:
        if a % 100 == 0:
            own = sorted(((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in use if i != a and len(v) == len(va)))
            for s, p, _ in [r for r in own if r[2] == la][:5]:
                fits = [(n, i) for n, i, label in own if label != la and 30 * -s <= 100 * -n <= 90 * -s]
                out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits[:10])]
    return sorted(out)


SMALL = {"BUCKET_BYTES": 256, "BLOCK_BYTES": 64, "CHUNK_BYTES": 512, "GROUP_BYTES": 128}


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_negatives_match_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(negatives, k, v)
    rng = np.random.default_rng(1)
    rows = [(i * 20, (rng.normal(size=4) * rng.choice([0.1, 1, 4])).tolist(), int(rng.integers(0, 3))) for i in range(60)]
    rows += [(5, rows[0][1], 1), (15, rows[0][1], 0), (25, rows[0][1], 0), rows[3], (35, [0.0] * 4, 1), (400, [1.0, 2.0], 0), (401, [1.0, 2.5], 0), (403, [0.5, 1.0], 1), (7, [], 1), (500, [], 0), (9, [], 0)]
    rows += [(None, [1.0] * 4, 1), (8, None, 1), (11, [1.0] * 4, None), (13, [1.0, None, 1.0, 1.0], 1), (17, [float("nan")] * 4, 1), (19, [float("inf")] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("clash")).withColumn("length", F.lit(1))
    assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == mined(rows)


def test_negatives_of_large_whole_numbers(spark):
    """Scores beyond 2^24 and 2^53 are exact as well."""
    rng = np.random.default_rng(2)
    for scale in (2.0**-6, 2.0**14):
        rows = [(i * 25, (rng.integers(1, 1 << 8, 3) * scale).tolist(), i % 2) for i in range(16)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == mined(rows)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(none).collect() == []
    alone = spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(alone).collect() == []


# ---------------------------------------------------------------- packing


def test_units_give_the_tokenizers_ids():
    t, cache, rng = Tokenizer.from_file(BPE), packing.UnitCache(BPE, 0), random.Random(1)
    some = ["a", "B", " ", "  ", "\n", "é", "1", ".", "'s", "’", "\t", "日", " the", "<|", " ", "!?", "word", " "]
    texts = [x or "" for x in ODD_TEXTS] + ["".join(rng.choice(some) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    packing_limit = packing.CACHE_UNITS
    try:
        for limit in (packing_limit, 50):  # beyond the limit units are held for their block alone
            packing.CACHE_UNITS = limit
            for a in range(0, len(texts), 400):
                values, n = cache.ids(texts[a : a + 400])
                stop = np.cumsum(n)
                for x, i, j in zip(texts[a : a + 400], stop - n, stop):
                    assert values[i:j].tolist() == t.encode(x, add_special_tokens=False).ids + [0], repr(x)
    finally:
        packing.CACHE_UNITS = packing_limit


def check_packing(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    packed, pieces = packing.pack(df, BPE, size=size)
    got = packed.toPandas()
    t = Tokenizer.from_file(BPE)
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], np.uint32) for i, x in rows}
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed, pieces).collect()}
    assert sorted(whole) == list(range(len(whole)))
    at, pads = dict.fromkeys(ids, 0), 0
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        own = ids[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes()
        assert r.start == at[r.doc_id] and len(own) == 4 * r.length and zlib.crc32(own) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == own
        at[r.doc_id] += r.length
    assert all(at[i] == len(x) for i, x in ids.items())
    for s, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        n = int(part.length.sum())
        assert n <= size and len(whole[s]) == 4 * n
        pads += 0 if n & (n - 1) == 0 else size - n
    assert pads == 0
    return got


def test_packing_covers_each_id_once_without_padding(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "of", "Haus", "über", "12", "x-y"], k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(1000 + i, x) for i, x in enumerate(ODD_TEXTS)]
    got = check_packing(spark, rows, 64)
    pieces = got.groupby("doc_id").size()
    assert (pieces > np.ceil(got.groupby("doc_id").doc_tokens.first() / 64)).mean() < 0.25  # most documents are cut at full pieces alone


def test_packing_where_no_two_lengths_fit(spark):
    check_packing(spark, [(i, "of " * 40) for i in range(50)], 64)
    check_packing(spark, [(1, None)], 64)


def test_packing_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, BPE)[0].collect() == []
    same = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d")], "doc_id long, text string")
    got = packing.pack(same, BPE, size=8)[0].collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got if r["start"] == 0)[0][0] == 0 and sum(r["length"] for r in got) == 10
    with pytest.raises(ValueError):
        packing.pack(none, BPE, size=1000)


def test_program_reaches_the_least_padding():
    # 600 + 424 and 512 + 512 fill sequences, 700s stand alone
    lengths, counts = np.array([424, 512, 600, 700]), np.array([30, 20, 30, 10])
    p = packing.Program(lengths, counts.astype(float), 1024)
    p.solve(counts.astype(float))
    cost = sum(b[2] * x for b, x in zip(p.basis, p.amounts))
    assert cost == pytest.approx(30 * 1024 + 20 * 512 + 10 * 1024)
    patterns, left = packing.rounded(lengths, counts, 1024)
    assert left.tolist() == [0, 0, 0, 10] and sum(int(lengths[a] @ c) * n for a, c, n in patterns) == 30 * 1024 + 20 * 512
