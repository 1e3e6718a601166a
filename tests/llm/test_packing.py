import random
from collections import defaultdict

from quarry.llm import packing as P


def _brute(items, capacity):
    bins, out = [], []
    for length, source, cluster in items:
        fit = [(room, b) for b, (room, s, c) in enumerate(bins)
               if room >= length and (source is None or source not in s)
               and (cluster is None or cluster not in c)]
        if fit:
            b = min(fit)[1]
        else:
            b = len(bins)
            bins.append((capacity, set(), set()))
        room, s, c = bins[b]
        out.append((b, capacity - room))
        bins[b] = (room - length, s | {source}, c | {cluster})
    return out


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(1)
    for _ in range(60):
        items = [(rng.randrange(1, 21), rng.choice([None, "a", "b", "c", "a"]),
                  rng.choice([None, None, 1, 2, 3])) for _ in range(rng.randrange(80))]
        assert P.best_fit(items, 20) == _brute(items, 20)


def _check(rows, packed, capacity):
    text = dict((i, (t, s)) for i, t, s in rows)
    bins = defaultdict(list)
    for r in packed:
        if r.bin is not None:
            bins[r.bin].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert sum(r.length for r in held) <= capacity
        for a, b in zip(held, held[1:]):
            assert a.offset + a.length == b.offset
        sources = [text[r.doc_id][1] for r in held if text[r.doc_id][1] is not None]
        assert len(set(sources)) == len(sources)
        words = [" ".join((text[r.doc_id][0] or "").lower().split()) for r in held]
        assert len(set(words)) == len(words)
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
    for held in pieces.values():
        held.sort(key=lambda r: r.piece)
        assert [r.piece for r in held] == list(range(len(held)))
        assert all(r.start == capacity * r.piece for r in held)
        assert all(r.length == capacity for r in held[:-1])


def test_packing_is_whole_and_does_not_depend_on_order(frame):
    rng = random.Random(2)
    rows = [(i, " ".join("w%d" % rng.randrange(50) for _ in range(rng.randrange(0, 90))),
             rng.choice(["s1", "s1", "s2", "s3", None])) for i in range(300)]
    rows += [(500 + i, t.upper() if t else t, "s%d" % i) for i, (_, t, _) in enumerate(rows[:30])]
    rows += [(900, None, "s1"), (901, "", None), (902, "x " * 5000, "s2")]
    schema = "doc_id long, text string, source string"
    docs = frame(rows, schema, clash=("length", "bin", "shard", "cluster"))
    for shard_rows in (40, 4096):
        packed = P.pack(docs, capacity=64, shard_rows=shard_rows).collect()
        _check(rows, packed, 64)
        lengths = defaultdict(int)
        for r in packed:
            lengths[r.doc_id] += r.length
        assert dict(lengths) == {i: len((t or "").split()) for i, t, _ in rows}
        shuffled = frame(rows[::-1], schema).repartition(5)
        again = P.pack(shuffled, capacity=64, shard_rows=shard_rows).collect()
        assert sorted(map(tuple, packed), key=str) == sorted(map(tuple, again), key=str)
    none = [r for r in packed if r.doc_id in (900, 901)]
    assert all(r.length == 0 and r.bin is None and r.offset is None for r in none)


def test_repeated_rows_null_ids_and_empty_tables(frame):
    schema = "doc_id long, text string, source string"
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None)]
    packed = P.pack(frame(rows, schema), capacity=10).collect()
    assert sorted(r.length for r in packed) == [2, 3, 3]
    assert len({r.bin for r in packed if r.doc_id == 1}) == 2
    assert P.pack(frame([], schema)).count() == 0
