import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import lines as L
from quarry.llm.shared import Scratch


def _as_lines(rows):
    words = [np.array(r, np.int64) for r in rows]
    bounds = np.append(0, np.cumsum([len(w) for w in words]))
    flat = np.concatenate(words)
    return L.Lines(L.line_keys(flat, bounds), flat, bounds)


def _signature(lines, line, place):
    line, place = np.array(line), np.array(place)
    parts = lines.parity(line, np.maximum(place, 0))
    return [lines.size[line], place, *parts]


def test_lines_within_the_similarity_are_never_ruled_out():
    """Whatever the edits before and after a run that is in both lines."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(5, 60)
        base, other, at = [rng.randrange(30) for _ in range(n)], [], 0
        run = rng.randrange(n - 2)
        most = int(0.2 * n + 1e-9)
        spots = [x for x in range(n) if not run <= x < run + 3]
        changed = set(rng.sample(spots, min(rng.randrange(most + 1), len(spots))))
        for x, w in enumerate(base):
            if x == run:
                at = len(other)
            if x not in changed:
                other.append(w)
            elif rng.random() < 0.5:
                other.append(rng.randrange(30, 60))
        lines = _as_lines([base, other])
        for places in ([run, at], [-1, at], [run, -1], [-1, -1]):
            if max(len(base), len(other)) * 0.2 >= len(changed):
                got = L.may_match(_signature(lines, [0, 1], places), np.array([0]),
                                  np.array([1]), 0.8)
                assert len(got) == 1


def test_lines_of_the_same_words_elsewhere_are_ruled_out(frame, monkeypatch):
    """Lines of the same words in other orders, all with one run in common, are no pairs to move
    words for: their number would grow with the square of the lines."""
    rng, sent, links = random.Random(6), [], L._links

    def counted(pairs, *rest):
        sent.append(pairs.distinct().count())
        return links(pairs, *rest)

    monkeypatch.setattr(L, "_links", counted)
    vocabulary = ["w%d" % x for x in range(37)]
    lines = []
    for _ in range(120):
        words = rng.sample(vocabulary, 37)
        words.insert(rng.randrange(38), "here are three")
        lines.append(" ".join(words))
    docs = frame(list(enumerate(lines)), "doc_id long, text string")
    assert all(not r.removed for r in L.mark_lines(docs, **L.WHOLE).collect())
    assert len(sent) == 2 and sum(sent) < 400           # of 7,140


def test_copies_in_other_tasks_take_no_runs(spark, monkeypatch):
    """A line that many documents have is one line: nothing is stored for it but its spots."""
    rows, keep = {}, Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    text = "\n".join(" ".join("word%d" % (31 * x + y) for y in range(30)) for x in range(5))
    docs = spark.range(40, numPartitions=4).select(F.col("id").alias("doc_id"),
                                                   F.lit(text).alias("text"))
    got = L.mark_lines(docs, **L.WHOLE).collect()
    assert sorted(len(r.removed) for r in got) == [0] + [5] * 39
    assert rows["runs"] == 0 and rows["distinct"] == 5


def test_large_groups_are_dealt_and_small_ones_are_not_lost(frame):
    rng = random.Random(8)
    base = ["word%d" % x for x in range(30)]
    lines = []
    for x in range(60):
        words = list(base)
        for y in rng.sample(range(30), 5):
            words[y] = "other%d" % (100 * x + y)
        lines.append(" ".join(words))
    lines.append(" ".join(base))
    docs = frame(list(enumerate(lines)), "doc_id long, text string")
    for block in (3, 2048):
        gone = {r.doc_id for r in L.mark_lines(docs, **L.WHOLE, block=block).collect() if r.removed}
        assert gone == set(range(1, 61))


def test_all_characters_at_once_give_the_same_lines():
    rng = random.Random(9)
    signs = "aAbBΣσςİiıßẞ今天คน_-\n\n \t\r\x85Ǆǅ9٣\U00020001é"
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(2000)]
    texts += ["", None, "\n", " \n-- \n", "ΟΔΟΣ οδος ΟΔΟΣΑ", "x" * 5000]
    texts += [chr(c) + "x " + chr(c) for c in range(0x3000)]
    for least in (1, 2):
        one = L.text_lines(texts, L.Words(), least)
        two = L.parsed_lines(texts, least)
        for x in (0, 1, 3):
            assert (one[x] == two[x]).all()
        pairs = set(zip(one[2].tolist(), two[2].tolist()))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert len(L.parsed_lines([], 1)[2]) == 0
