import json

from pyspark.sql import functions as F

from quarry.operators import generation as gen
from quarry.operators.secrets import is_key_format, secret_scan
from quarry.operators.splitting import split_parts


def test_prompt_with_and_without_context(spark):
    df = spark.createDataFrame([('Say "hi"\nnow', ["c1", 'c "2"']), ("q", None)],
                               "q string, ctx array<string>")
    rows = df.select(gen.build_prompt(F.col("q"), F.col("ctx")).alias("p")).collect()
    assert gen.SECTION_CONTEXT in rows[0]["p"] and '- c1\n- c "2"' in rows[0]["p"]
    assert 'Say "hi"\nnow' in rows[0]["p"]
    assert gen.SECTION_CONTEXT not in rows[1]["p"]
    assert all(r["p"].endswith(gen.SECTION_ANSWER + "\n") for r in rows)


def test_payload_shapes(spark):
    df = spark.createDataFrame([("openai:gpt-3.5-turbo", 'a "b"\nc'), ("mistral:7b-instruct", "x")],
                               "model string, prompt string")
    df = df.withColumn("family", gen.family_of("model"))
    bodies = [json.loads(r[0]) for r in df.select(gen.payload("model", "family", "prompt")).collect()]
    assert bodies[0] == {"model": "gpt-3.5-turbo", "temperature": 0.7,
                         "messages": [{"role": "user", "content": 'a "b"\nc'}]}
    assert bodies[1] == {"model": "mistral:7b-instruct", "stream": False, "prompt": "x",
                         "options": {"temperature": 0.7, "repeat_penalty": 1.2}}


def test_parse_non_200_and_malformed(spark):
    df = spark.createDataFrame([
        (1, "hosted", 200, '{"choices":[{"message":{"content":"yes"}}]}'),
        (2, "local", 200, '{"response":"ok"}'),
        (3, "local", 500, '{"response":"ok"}'),
        (4, "hosted", 200, '{"choices":[{"message":'),
    ], "query_id long, family string, status int, body string")
    p = {r["query_id"]: (r["result"], r["error"]) for r in gen.parse_responses(df).collect()}
    assert p[1] == ("yes", None) and p[2] == ("ok", None)
    assert p[3][0] is None and "500" in p[3][1]
    assert p[4] == (None, "malformed reply")


def test_route_models_k(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "conv_id long")
    r = {x["conv_id"]: (x["family"], x["k"]) for x in gen.route_models(df).collect()}
    assert r == {0: ("hosted", 10), 1: ("local", 3), 2: ("local", 3)}


def test_secret_scan_and_key_format(spark):
    key = "sk-" + "a" * 20 + "T3BlbkFJ" + "b" * 20
    df = spark.createDataFrame([(1, f"x {key} y {'f' * 40}."), (2, "no secrets"),
                                (3, f"{'a' * 40} {'b' * 40},{'c' * 41} x{'d' * 40}")],
                               "doc_id long, text string")
    hits = sorted((r["doc_id"], r["kind"], r["secret"]) for r in secret_scan(df).collect())
    # one separator between two secrets: both found; 41 chars or a glued prefix: none
    assert hits == [(1, "api_key", key), (1, "hex40", "f" * 40),
                    (3, "hex40", "a" * 40), (3, "hex40", "b" * 40)]
    assert df.select(is_key_format(F.lit(key))).first()[0] is True


def test_split_parts_rules(spark):
    text = "aaaa\nbb\ncccc\nd"
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    parts = [tuple(r) for r in split_parts(df, 2).orderBy("doc_id", "part").collect()]
    # size 15, target 7: "aaaa\n"(5) + "bb\n"(3) reaches 8 -> part 0; rest -> part 1
    assert parts == [(1, 0, 0, 2, 8), (1, 1, 2, 2, 7)]
    many = split_parts(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"), 10)
    assert many.count() == 2  # target 0: one line per part


def test_append_text_and_part_lines(spark, tmp_path):
    from quarry.operators.splitting import append_text, part_lines
    df = spark.createDataFrame([(1, "aaaa\nbb\ncccc\nd")], "doc_id long, text string")
    lines = part_lines(df, 2).orderBy("line_no").collect()
    assert [(r["part"], r["line"]) for r in lines] == [(0, "aaaa"), (0, "bb"), (1, "cccc"),
                                                        (1, "d")]
    out = str(tmp_path / "parts")
    append_text(spark.createDataFrame([("x",)], "value string"), out)
    append_text(spark.createDataFrame([("y",)], "value string"), out)  # created, then appended
    assert sorted(r[0] for r in spark.read.text(out).collect()) == ["x", "y"]


def test_answers_join(spark):
    parsed = spark.createDataFrame([(1, 200, "A", None), (2, 500, None, "failed")],
                                   "query_id long, status int, result string, error string")
    results = spark.createDataFrame([(1, [5, 6], ["d1", "d1"], ["c5", "c6"])],
                                    "query_id long, idx_list array<long>, doc_names array<string>,"
                                    " chunks array<string>")
    rows = gen.answers(parsed, results).collect()
    assert len(rows) == 1 and rows[0]["idx_list"] == [5, 6]
    assert json.loads(rows[0]["served"]) == {"result": "A", "doc_names": ["d1"]}


def test_rag_payloads_context_size_by_family(spark):
    from testdata_paths import SF001
    from quarry.plans.queries import doc_chunk_rows
    from quarry.plans.rag import rag_payloads
    corpus = doc_chunk_rows(spark, SF001)
    qs = spark.createDataFrame([(1, 0, "the river"), (2, 1, "a small house")],
                               "query_id long, conv_id long, text string")
    rows = {r["query_id"]: r for r in rag_payloads(corpus, qs).collect()}
    hosted = json.loads(rows[1]["body"])  # conv 0 -> hosted model
    local = json.loads(rows[2]["body"])   # conv 1 -> local model
    assert rows[1]["k"] == 10 and rows[2]["k"] == 3
    ctx_h = hosted["messages"][0]["content"].split(gen.SECTION_CONTEXT + "\n")[1]
    ctx_l = local["prompt"].split(gen.SECTION_CONTEXT + "\n")[1]
    assert ctx_h.count("\n- ") + 1 == 10 and ctx_l.count("\n- ") + 1 == 3
