import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import induced as I
from quarry.llm import substrings as S


@pytest.mark.parametrize("memory_rows", [5, 1 << 20])
@pytest.mark.parametrize("block_rows", [1, 4, 1 << 16])
def test_suffix_array_in_memory_and_on_disk(memory_rows, block_rows):
    rng = np.random.default_rng(0)
    for trial in range(120):
        text = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 160)))
        if trial % 5 == 0:
            text = np.tile(text[:max(1, len(text) // 7)], 9)
        rows = text.tolist()
        got = I.suffix_array(text.astype(np.int64), 6, memory_rows, block_rows)
        assert list(got) == sorted(range(len(rows)), key=lambda i: rows[i:])


def _brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans, k = [], 0
        while k < len(d):
            if gone[k]:
                e = k
                while e < len(d) and gone[e]:
                    e += 1
                spans.append((k, e))
                k = e
            else:
                k += 1
        out.append((len(d), bytes(x for x, g in zip(d, gone) if not g), spans))
    return out


def _texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(40) for _ in range(4)]
    out = [None, "", "short", "a" * 700, "ab" * 300, "a" * 250]
    for _ in range(60):
        parts = [line(rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 40)
            parts += [s[a:a + rng.randrange(20, 220)], line(rng.randrange(1, 20))]
        out.append("".join(parts))
    out += [out[8], out[8], out[9], out[9] + "tail", "x" + out[10], line(30) + "0" * 400]
    return out


@pytest.mark.parametrize("options", [
    {}, {"most": 1}, {"memory_rows": 64, "shard_bytes": 500}], ids=["sorted", "hashed", "on disk"])
def test_spans_equal_brute_force(frame, options, monkeypatch):
    length, texts = 60, _texts(2)
    docs = frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string",
                 clash=("h", "c", "t", "u", "spans", "kept", "size")).repartition(3)
    got = S.remove_repeats(docs, length=length, gram=16, **options).collect()
    want = _brute(texts, length)
    assert len(got) == len(texts)
    for r in got:
        n, kept, spans = want[r.doc_id]
        assert (r.n_bytes, bytes(r.kept), [(s.start, s.end) for s in r.spans]) == (n, kept, spans)


def test_regions_do_not_depend_on_the_step(monkeypatch):
    texts = [t for t in _texts(3) if t]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    found = []
    for step in (S.STEP, 97):
        monkeypatch.setattr(S, "STEP", step)
        r = S.regions(data, bounds, 60, 16, S.Rolling(S.STEP + 120 if step > 97 else 400))
        found.append(sorted((int(a), k, int(h)) for a, s, e, h in zip(
            r["row"], r["start"], r["end"], r["h"]) for k in range(s, e)))
    assert found[0] == found[1]


def test_repeated_rows_and_empty_tables(frame):
    text = "z" * 30 + "".join(map(chr, range(97, 123))) * 3
    docs = frame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = S.remove_repeats(docs, length=50, gram=16).collect()
    assert [bytes(r.kept) for r in got] == [b""] * 3
    empty = frame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0
