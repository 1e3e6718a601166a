import random
import zlib

import numpy as np

from quarry.llm import toxicity as X


def _brute_segments(scores):
    """Maximal segments by their recursive definition: the best segment, then both sides."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-12 and (best is None or s > best[2] + 1e-12):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    right = [(a + j, b + j, t) for a, b, t in _brute_segments(scores[j:])]
    return _brute_segments(scores[:i]) + [best] + right


def test_segments_equal_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.normal(-0.3, 1, rng.integers(0, 18))
        got = [(a, b, round(s, 9)) for a, b, s in X.maximal_segments(scores)]
        assert got == [(a, b, round(s, 9)) for a, b, s in _brute_segments(scores.tolist())]


def _corpus(n=700, seed=1):
    rng = random.Random(seed)
    plain = ["w%d" % i for i in range(300)]
    docs, labels = [], []
    for d in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile", "nasty", "AWFUL"]))
        docs.append((d, " ".join(words)))
        if d % 2 == 0:
            labels.append((d, int(toxic)))
    return docs, labels, {d: any(w in t for w in ("Vile", "nasty", "AWFUL")) for d, t in docs}


def test_held_out_accuracy_spans_and_edges(frame):
    docs, labels, truth = _corpus()
    odd = [(None, "w1 w2"), (9000, None), (9001, ""), (9002, "vile " * 3000), (4, docs[4][1])]
    labels += [(0, None), (None, 1), (2, 0), (99999, 1)]
    table = frame(docs + odd, "doc_id long, text string", clash=("score", "passages", "key"))
    model = X.learn(table, frame(labels, "doc_id long, toxic int"))
    got = X.score(table, model).collect()
    assert len(got) == len(docs) + len(odd)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 9000
            and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [r.predicted == truth[r.doc_id] for r in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id == 9002:
            assert r.predicted == 1 and r.passages
        if r.doc_id in (9000, 9001):
            assert r.predicted == 0 and not r.passages
        text = dict(docs + odd).get(r.doc_id) or ""
        assert all(text[p.start:p.end].strip() == text[p.start:p.end] for p in r.passages)


def test_without_labels_nothing_is_toxic(frame):
    docs = frame([(1, "any text"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, None)]):
        model = X.learn(docs, frame(labels, "doc_id long, toxic int"))
        assert [r.predicted for r in X.score(docs, model).collect()] == [0, 0]
    assert X.score(docs.limit(0), model).count() == 0


def test_short_texts_are_told_apart(frame):
    words = {"rock": 0, "win": 0, "are": 0, "can": 0, "vile": 1, "nasty": 1}
    docs = [(i, f"you {w}") for i, w in enumerate(list(words) * 60)]
    labels = [(i, words[t.split()[1]]) for i, t in docs]
    table = frame(docs, "doc_id long, text string")
    model = X.learn(table, frame(labels, "doc_id long, toxic int"))
    keys = {X.copy_key(X.Buckets(X.BUCKETS).ids(t)) for _, t in docs}
    assert len(keys) == len(words)
    told = {r.text: r.score for r in X.score(table, model).collect()}
    assert min(told["you vile"], told["you nasty"]) >= max(
        s for t, s in told.items() if not words[t.split()[1]])


def test_copies_of_unlike_labels_both_count(frame):
    ids = X.Buckets(X.BUCKETS)
    long = " ".join(f"w{i}" for i in range(60))
    assert X.copy_key(ids.ids(long)) == X.copy_key(ids.ids(long.upper()))
    assert X.copy_key(ids.ids(long)) != X.copy_key(ids.ids(long[:-4]) [::-1])
    assert X.copy_key(ids.ids("a b")) != X.copy_key(ids.ids("a b c d e f"))
    assert X.copy_key(ids.ids(None)) == X.copy_key(ids.ids("...")) == -1


def test_dropping_equals_scoring(frame):
    docs, labels, _ = _corpus(300, seed=4)
    docs += [(None, "nasty vile awful nasty vile"), (9000, None), (9001, "")]
    table = frame(docs, "doc_id long, text string", clash=("score", "predicted"))
    model = X.learn(table, frame(labels, "doc_id long, toxic int"))
    kept = X.drop_toxic(table, model)
    assert kept.schema == table.schema
    told = X.score(table.select("doc_id", "text"), model).filter("predicted = 0")
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(
        map(repr, told.select("doc_id", "text").collect()))
