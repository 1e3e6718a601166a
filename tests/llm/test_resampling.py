"""Importance resampling against plain zlib CRCs and Python's own arithmetic."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from quarry.llm import resampling as R
from quarry.llm import wordscan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, lo, hi):
    ws = words(text)
    return [" ".join(ws[i:i + n]) for n in range(lo, hi + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, lo=1, hi=1, buckets=10000, min_words=20, percent=10, seed=2024):
    name = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for count, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for g in grams(text, lo, hi):
                count[name(g)] += 1
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (sum(s) + buckets))
                                       / ((s[b] + 1) * (sum(t) + buckets))))
            for b in range(buckets)]
    rows = []
    for i, text in docs:
        found = grams(text, lo, hi)
        weight = sum(gain[name(g)] for g in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= min_words),
                  key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in rows], key=repr)


def some_docs(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA9", "é", "漢字", "x", "under", "license"]
    docs = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ", \n"])
                         for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "--- \x00"), (None, "beta " * 30),
                   (n + 3, "long" * 50_000 + " x" * 30)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_crcs_from_prefix_registers(n):
    texts = [t for _, t in some_docs(200)]
    found = wordscan.scan(pa.array(texts))
    crc, text = R.ngram_crcs(found, R.prefix_registers(found.flat), n)
    want = [(zlib.crc32(g.encode()), i) for i, t in enumerate(texts) for g in grams(t, n, n)]
    assert list(zip(crc.tolist(), text.tolist())) == want


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c" * 5] * 7)
    for limit in (1, 16, 100, 10_000):
        cuts = list(wordscan.slices(texts, limit))
        assert cuts[0][0] == 0 and cuts[-1][1] == len(texts)
        assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))


@pytest.mark.parametrize("lo,hi,buckets", [(1, 1, 10000), (1, 3, 64)])
def test_against_plain_crcs(spark, frame, lo, hi, buckets):
    docs = some_docs(150)
    target = [t for _, t in some_docs(20, seed=2)][:20] + [None]
    got = R.resample(frame(docs, "doc_id long, text string", ("id", "buckets", "score", "_row")),
                     frame([(i, t) for i, t in enumerate(target)], "item_id long, text string"),
                     min_n=lo, max_n=hi, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, lo, hi, buckets)


def test_repeated_rows_and_empty_tables(spark, frame):
    schema = "doc_id long, text string"
    docs = [(1, "a " * 25)] * 12 + [(2, "b " * 25)] * 10
    got = R.resample(frame(docs, schema), frame([], "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, [])
    none = R.resample(frame([], schema), frame([(1, "a b")], "item_id long, text string"))
    assert none.collect() == []
    assert none.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_the_registered_query(spark, tmp_path):
    from quarry.llm.queries import op13_resampling
    docs, target = some_docs(60, seed=5), ["alpha beta", None, "license x"]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"
                          ).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = op13_resampling(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target)
