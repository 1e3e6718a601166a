"""Prefix trie against a brute-force version that walks every prefix of every conversation."""

import hashlib
import math
import random
import zlib

import pytest

from quarry.llm import prefix_trie as P
from quarry.llm.shared import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def originals(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in out.items()}


def grafted(convs):
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]     # % as in SQL
    return out


def brute(convs):
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        cost = (len(members) - 1) * (len(p[-1][1]) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += p not in kids
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0),
                   leaves[p], saved[p], sha(",".join(
                       str(c) for c in sorted(m) if len(convs[c]) == len(p))))
                  for p, m in nodes.items())


def made(spark, rows, clash=(), segment=P.SEGMENT, graft=False, frame=None):
    scratch = Scratch(spark, "trie")
    df = frame(rows, SCHEMA, clash) if frame else spark.createDataFrame(rows, SCHEMA)
    turns = P.numbered_turns(df, scratch)
    if graft:
        turns, convs = P.graft(turns, scratch)
    else:
        turns = scratch.keep(turns, "numbered")
        from pyspark.sql import functions as F
        convs = turns.groupBy("conv").agg(F.count("*").alias("length"))
    out = P.prefix_trie(turns, convs, scratch, segment)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                           "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()),
                  key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, *r[3:]))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, *r[3:]))


def some_rows(seed, convs=40, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        length = rng.randint(1, most)
        # few texts, so prefixes are shared, and whole conversations are copies
        rows += [(c, t if t else None, rng.choice(["user", None]) if t > 5 else "user",
                  rng.choice(["é", "bb", ""]) if t % 3 == 0 else "same")
                 for t in range(length)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,segment", [(1, 4096), (2, 2), (3, 3)])
def test_against_all_prefixes(spark, seed, segment):
    rows = some_rows(seed)
    assert made(spark, rows, segment=segment) == ordered(brute(originals(rows)))


def test_grafted_conversations_nulls_and_clashing_names(spark, frame):
    rng = random.Random(7)
    rows = some_rows(4, convs=30)
    rows += [(c, t, "user", rng.choice(["x", "y"])) for c in (100, 101, 137, 215, -5, -3)
             for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "no conversation"), (999, None, None, None)]
    got = made(spark, rows, clash=("conv", "seq", "end", "up", "n", "a", "part"), graft=True,
               frame=frame)
    assert got == ordered(brute(grafted(originals(rows))))


def test_long_conversations_and_a_large_group_of_copies(spark):
    rows = [(c, t, "user", f"{t % 7}") for c in range(3) for t in range(200 + 60 * c)]
    rows += [(10 + c, 0, "user", "copy") for c in range(300)]
    assert made(spark, rows, segment=50) == ordered(brute(originals(rows)))


def test_an_empty_table_and_one_conversation(spark):
    assert made(spark, []) == []
    assert made(spark, [(5, 0, "user", "abc")]) == [
        (5, 0, None, 1, 1, 1, 0, sha("")), (5, 1, 5, 1, 0, 1, 0, sha("5"))]


def test_repeated_turns_and_equal_numbers_keep_every_row(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    assert made(spark, rows) == ordered(brute(originals(rows)))


def test_the_registered_query(spark, tmp_path):
    from quarry.llm.queries import op12_prefix_trie
    rows = some_rows(11, convs=25)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, op12_prefix_trie(spark, str(tmp_path)).collect()),
                 key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, *r[3:]))
    assert got == ordered(brute(grafted(originals(rows))))
