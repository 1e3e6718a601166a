"""Cuts of texts in rows against a plain loop."""

import random

import pytest

from quarry.operators.long_text import pack_sentences, split_lines


def table(spark, texts):
    rows = [(d, i, c) for d, costs in texts.items() for i, c in enumerate(costs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc long, pos int, cost int")


def parts(costs, n):
    target, out, acc, first = sum(costs) // n, [], 0, 0
    for i, c in enumerate(costs):
        acc += c
        if acc >= target:
            out.append((first, i + 1 - first, acc))
            acc, first = 0, i + 1
    return out + ([(first, len(costs) - first, acc)] if first < len(costs) else [])


def chunks(costs, limit):
    out, acc, first = [], 0, 0
    for i, c in enumerate(costs):
        if i > first and acc + c > limit:
            out.append((first, i - first, acc))
            acc, first = 0, i
        acc += c
    return out + [(first, len(costs) - first, acc)]


def texts(seed):
    rng = random.Random(seed)
    out = {d: [rng.randint(1, 40) for _ in range(rng.randint(1, 30))] for d in range(25)}
    return out | {99: [rng.randint(1, 9) for _ in range(1500)], 100: [500], 101: [500, 1, 500]}


@pytest.mark.parametrize("n", [3, 50])
def test_parts(spark, n):
    made = texts(n)
    got = sorted(map(tuple, split_lines(table(spark, made), n).collect()))
    assert got == sorted((d, k, *p) for d, c in made.items() for k, p in enumerate(parts(c, n)))


def test_chunks(spark):
    made = texts(7)
    got = sorted(map(tuple, pack_sentences(table(spark, made), 60).collect()))
    assert got == sorted((d, k, *p) for d, c in made.items() for k, p in enumerate(chunks(c, 60)))


def test_no_rows(spark):
    none = table(spark, {1: [1]}).limit(0)
    assert split_lines(none, 3).collect() == [] and pack_sentences(none, 9).collect() == []
