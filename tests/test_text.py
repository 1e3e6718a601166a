import pytest
from pyspark.sql import functions as F

from quarry.functions.text import sentence_split
from quarry.operators import chunking

NBSP = " "

# Sentence-split edge cases (input -> sentences)
CASES = [
    ("", []),
    ("   ", ["   "]),
    ("word", ["word"]),
    ("word\n", ["word", "\n"]),
    ("x\n\n", ["x\n", "\n"]),
    ("word\r\n", ["word\r", "\n"]),
    ("Hi.\n", ["Hi."]),
    ("Hi. Yo!  Z?\n\nq", ["Hi.", "Yo!", "Z?", "q"]),
    ("a...b. c", ["a...b.", "c"]),
    (f"e.{NBSP}f", ["e.", "f"]),
    (" . . b", [" .", ".", "b"]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_sentence_split(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(sentence_split("text").alias("s")).first()["s"] == expected


# Fixed value: the documented chunking example.
GOLDEN = ("Hold me closer, tiny dancer. Count the headlights on the highway. Lay me down in "
          "sheets of linen. Peter Piper picked a peck of pickled peppers. A peck of pickled "
          "peppers Peter Piper picked.\n")


def _chunks(spark, text, limit):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = chunking.chunkify(df, limit=limit).orderBy("chunk_no").collect()
    return [r["chunk"] for r in rows], [r["n_tokens"] for r in rows]


def test_chunkify_golden_limit_20(spark):
    chunks, _ = _chunks(spark, GOLDEN, 20)
    assert chunks == [
        "Hold me closer, tiny dancer. Count the headlights on the highway.",
        "Lay me down in sheets of linen.",
        "Peter Piper picked a peck of pickled peppers.",
        "A peck of pickled peppers Peter Piper picked.",
    ]


def test_sentence_costs_include_special_tokens(spark):
    df = spark.createDataFrame([(1, GOLDEN)], "doc_id long, text string")
    costs = [r["n_tokens"] for r in chunking.sentences(df).orderBy("sent_no").collect()]
    assert costs == [9, 9, 10, 11, 11]


def test_long_sentence_is_own_chunk_uncut(spark):
    long = " ".join(["word"] * 50) + "."
    chunks, toks = _chunks(spark, f"Short one. {long} Tail here.", 10)
    assert chunks == ["Short one.", long, "Tail here."]
    assert toks[1] > 10


def test_sum_equal_to_limit_fits(spark):
    # "a b." costs 3 + 2 = 5; two of them make exactly 10
    chunks, toks = _chunks(spark, "a b. c d. e f.", 10)
    assert chunks == ["a b. c d.", "e f."]
    assert toks == [10, 5]


def test_empty_document_has_no_chunk(spark):
    chunks, _ = _chunks(spark, "", 512)
    assert chunks == []


def test_chunk_properties_on_fixture(spark):
    from testdata_paths import SF01
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(200)
    sents = chunking.sentences(docs)
    chunks = chunking.chunkify(docs, limit=128)
    # concatenation of all chunks = sentences joined by one space
    s = sents.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("sent_no", "sentence"))), lambda x: x["sentence"]), " ").alias("a"))
    c = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), " ").alias("b"))
    assert s.join(c, "doc_id").where(F.col("a") != F.col("b")).count() == 0
    # every multi-sentence chunk stays within the limit
    nums = chunking.chunk_numbers(docs, limit=128)
    multi = nums.groupBy("doc_id", "chunk_no").agg(F.count("*").alias("n"),
                                                   F.sum("n_tokens").alias("t"))
    assert multi.where((F.col("n") > 1) & (F.col("t") > 128)).count() == 0


def test_long_document_equals_the_linear_rule(spark):
    from quarry.functions.text import greedy_starts
    from quarry.operators.chunking import with_sentences
    text = " ".join(f"Sentence number {i} has {'word ' * (i % 7)}end." for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, GOLDEN)], "doc_id long, text string")
    got = chunking.chunkify(df, limit=50)
    costs = {r.doc_id: r["_costs"] for r in with_sentences(df, "text").collect()}
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {d: len(greedy_starts(c, 50)) for d, c in costs.items()}
    assert greedy_starts([9, 9, 10, 11, 11], 20) == [0, 2, 3, 4]


def test_blocked_fold_equals_linear_reference(spark):
    import random
    from quarry.functions.text import chunk_starts, greedy_starts
    rnd = random.Random(7)
    rows = []
    for n in [0, 1, 2, 5, 7, 8, 9, 31, 64, 65, 300]:
        rows.append([rnd.randint(1, 9) for _ in range(n)])
    rows.append([12, 1, 1, 15, 2, 2, 2, 30, 1])  # over-long sentences
    df = spark.createDataFrame([(r,) for r in rows], "c array<int>")
    got = [r[0] for r in df.select(chunk_starts("c", 10, block=4)).collect()]
    assert got == [greedy_starts(r, 10) for r in rows]
