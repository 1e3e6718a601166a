import random
import re

import numpy as np
import xxhash

from quarry.llm import simhash as S
from quarry.llm.shared import majority_bits


def _brute_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or (
        [" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _brute(rows):
    fps = [_brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)] = min(doc, groups.get(find(i), doc))
    return sorted(((doc is None, doc or 0), _signed(fps[i]), groups.get(find(i)) or -1)
                  for i, (doc, _) in enumerate(rows))


def _rows(seed=1):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 300))]
        rows.append((d, " ".join(words)))
        for c in range(rng.randrange(3)):
            near = list(words)
            if near and c:
                near[rng.randrange(len(near))] = "new"
            rows.append((100 * d + c + 100, " ".join(near).upper()))
    return rows + [(None, None), (9001, ""), (9002, " \t\n"), (9003, "one two"), (9004, "One two"),
                   (9004, "One two"), (9005, "É é"), (9006, "x " * 20000)]


def test_groups_equal_brute_force_with_any_block_size(frame):
    rows = _rows()
    docs = frame(rows, "doc_id long, text string", clash=("fp", "component_id", "bucket"))
    for block in (2, 2048):
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.fp, r.component_id or -1)
                     for r in S.near_duplicates(docs, block=block).collect())
        assert [g[:2] for g in got] == [w[:2] for w in _brute(rows)]
        assert got == _brute(rows)


def test_every_pair_within_the_radius_shares_a_mask():
    rng = random.Random(5)
    masks = [m & (1 << 64) - 1 for m in S.covering_masks(4)]
    assert len(masks) == 31
    for _ in range(500):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(diff & m == 0 for m in masks)


def test_majority_bits_counts_beyond_one_byte():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 2, 255, 256, 1000, 0, 3]
    values = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64) * np.uint64(3)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for k, got in enumerate(majority_bits(values, bounds).tolist()):
        part = values[bounds[k]:bounds[k + 1]].tolist()
        assert got == sum(1 << b for b in range(64)
                          if 2 * sum(v >> b & 1 for v in part) > len(part))


def test_one_document_of_each_group_stays(frame):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"),
            (None, "quite another text with words"), (8, None), (7, "")]
    docs = frame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string",
                 clash=("row", "fp"))
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 3), (False, 7), (True, 0)]


def test_empty_table(frame):
    docs = frame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0
    assert S.drop_near_duplicates(docs).count() == 0


def _kept_plans(monkeypatch):
    """The plans of all tables that operators store from now on, as they are before they run."""
    from quarry.llm.shared import Scratch
    plans, keep = [], Scratch.keep

    def kept(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, name)
    monkeypatch.setattr(Scratch, "keep", kept)
    return plans


def test_no_table_that_grows_with_the_input_is_broadcast(spark, frame, monkeypatch):
    """Small here, so Spark would broadcast each; above all the masked rows after an explode,
    which it takes to be as few as the fingerprints."""
    plans = _kept_plans(monkeypatch)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[i:i + 30]) for i in range(4)] + [" ".join(words[:30])] * 2
    docs = frame(list(enumerate(texts)), "doc_id long, text string")
    for result in (S.near_duplicates(docs), S.drop_near_duplicates(docs)):
        plans.append(result._jdf.queryExecution().executedPlan().toString())
        assert result.count()
    joined = [p for p in plans if "Join" in p]
    assert len(joined) > 4 and any("Generate explode" in p for p in joined)
    for plan in joined:
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
