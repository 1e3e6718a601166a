import pytest
from pyspark.sql import functions as F

from quarry.operators.numbering import assign_dense_ids, next_idx
from quarry.plans.catalog import corpus_names
from quarry.plans.corpus import Corpus
from quarry.sources.text_files import read_text_docs


def test_dense_ids_are_1_to_n(spark):
    from testdata_paths import SF01
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(
        "doc_id", F.split("text", " ").alias("w"))
    ids = assign_dense_ids(docs, ["doc_id"], "w", "idx", 0, "pos")
    n = ids.count()
    agg = ids.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).first()
    assert tuple(agg) == (1, n, n)
    # order: doc order then position
    first = ids.where(F.col("idx") == 1).first()
    assert first["doc_id"] == docs.agg(F.min("doc_id")).first()[0] and first["pos"] == 0


def test_corpus_create_append_load(spark, tmp_path):
    path = f"{tmp_path}/corpus_data_x"
    c = Corpus.create(spark, path)
    assert c.next_idx() == 1  # empty corpus
    docs = spark.createDataFrame([(1, "a", "One. Two."), (2, "b", "Three.")],
                                 "doc_id long, doc_name string, text string")
    c.append_documents(docs)
    c.append_documents(docs)  # append never replaces: duplicates kept
    loaded = Corpus.load(spark, path)
    rows = loaded.chunks().orderBy("idx").collect()
    assert [r["idx"] for r in rows] == [1, 2, 3, 4]
    assert [r["doc_name"] for r in rows] == ["a", "b", "a", "b"]
    assert loaded.next_idx() == 5
    with pytest.raises(Exception):
        Corpus.create(spark, path)  # errorifexists by default
    Corpus.create(spark, path, mode="overwrite")
    assert Corpus.load(spark, path).next_idx() == 1


def test_append_chunks_and_rejects_bad_vectors(spark, tmp_path):
    c = Corpus.create(spark, f"{tmp_path}/c2")
    ch = spark.createDataFrame([("d", 0, "hello world"), ("d", 1, "second")],
                               "doc_name string, pos int, chunk string")
    c.append_chunks(ch, order_cols=("doc_name", "pos"))
    assert [r["chunk"] for r in c.chunks().orderBy("idx").collect()] == ["hello world", "second"]
    bad = spark.createDataFrame([(9, "x", 0, "x", [1.0])], c.chunks().schema)
    with pytest.raises(ValueError):
        c._write(bad, "x")


def test_search_tiny_corpus_rank1(spark, tmp_path):
    c = Corpus.create(spark, f"{tmp_path}/c3")
    docs = spark.createDataFrame([
        (1, "doc1", "Hold me closer, tiny dancer."),
        (2, "doc1", "Count the headlights on the highway."),
        (3, "doc2", "Peter Piper picked a peck of pickled peppers."),
        (4, "doc2", "A peck of pickled peppers Peter Piper picked.")],
        "doc_id long, doc_name string, text string")
    c.append_documents(docs)
    q = spark.createDataFrame([(0, "tiny dancer")], "query_id long, text string")
    hits = c.search(q, k=2).orderBy("rank").collect()
    assert hits[0]["idx"] == 1 and hits[0]["doc_name"] == "doc1" and len(hits) == 2
    assert hits[0]["distance"] <= hits[1]["distance"]


def test_corpus_names_suffix_only(spark):
    files = spark.createDataFrame([("a_data.json",), ("a.db",), ("my_data_set.bin",),
                                   (".DS_Store",), ("b.bin",)], "file_name string")
    names = sorted(r[0] for r in corpus_names(files).collect())
    assert names == ["a", "b", "my_data_set"]


def test_next_idx_empty(spark):
    empty = spark.createDataFrame([], "idx long")
    assert next_idx(empty).first()["next_idx"] == 1


def test_read_text_docs_missing_file(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("line one\nline two\n")
    df = read_text_docs(spark, [str(p), str(tmp_path / "missing.txt")], ["a", "m"])
    got = {r["doc_name"]: r["text"] for r in df.collect()}
    assert got == {"a": "line one\nline two\n", "m": ""}


def test_list_corpora_from_folder(spark, tmp_path):
    from quarry.plans.catalog import list_corpora
    for name in ["greek_data.json", "greek.db", "greek.bin", ".DS_Store", "notes_data_v2.json"]:
        (tmp_path / name).write_text("x")
    names = sorted(r[0] for r in list_corpora(spark, str(tmp_path)).collect())
    assert names == ["greek", "notes_data_v2"]


def test_read_models_file(spark, tmp_path):
    from quarry.sources.models import read_models
    p = tmp_path / "models.txt"
    p.write_text("openai:gpt-3.5-turbo\nmistral:7b-instruct\n\ngemma:7b-instruct\n")
    rows = [(r["model_no"], r["model"]) for r in read_models(spark, str(p)).orderBy("model_no")
            .collect()]
    assert rows == [(0, "openai:gpt-3.5-turbo"), (1, "mistral:7b-instruct"),
                    (2, "gemma:7b-instruct")]


def test_search_block_pruning_matches_full_scan(spark, tmp_path, monkeypatch):
    from testdata_paths import SF001
    from quarry.operators import search as srch
    from quarry.plans import corpus as C
    from quarry.plans.queries import _named_docs
    monkeypatch.setattr(C, "IDX_BLOCK", 10)
    c = C.Corpus.create(spark, f"{tmp_path}/blocks")
    c.append_documents(_named_docs(spark, SF001))
    assert c.chunks(with_block=True).select("idx_block").distinct().count() > 5
    q = spark.createDataFrame([(0, "the river"), (1, "a small house"), (2, "wind")],
                              "query_id long, text string")
    pruned = sorted(tuple(r) for r in c.search(q, k=4).collect())
    full = sorted(tuple(r) for r in srch.search(c.chunks(), q, k=4).collect())
    assert pruned == full and len(full) == 12


def test_next_idx_comes_from_the_commits(spark, tmp_path, monkeypatch):
    from quarry.plans import corpus as C
    monkeypatch.setattr(C, "IDX_BLOCK", 3)
    c = C.Corpus.create(spark, f"{tmp_path}/topblock")
    docs = spark.createDataFrame([(i, f"d{i}", "One. Two.") for i in range(7)],
                                 "doc_id long, doc_name string, text string")
    c.append_documents(docs)
    c.append_documents(docs)
    assert c.next_idx() == 15
    assert sorted(r["idx"] for r in c.chunks().collect()) == list(range(1, 15))
    assert c.commits().count() == 2
    blocks = c.chunks(with_block=True).agg(F.max("idx_block")).first()[0]
    assert blocks == 14 // 3


def test_read_text_dir(spark, tmp_path):
    from quarry.sources.text_files import read_text_dir
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("First. Second.\n")
    (tmp_path / "sub" / "b.txt").write_text("Third.")
    got = {r["doc_name"]: r["text"] for r in read_text_dir(spark, str(tmp_path)).collect()}
    assert got == {"a": "First. Second.\n", "b": "Third."}


def test_corpus_search_with_ivf_index(spark, tmp_path):
    from testdata_paths import SF001
    from quarry.operators.ann import IvfIndex
    from quarry.plans.queries import _named_docs
    c = Corpus.create(spark, f"{tmp_path}/ivfcorpus")
    c.append_documents(_named_docs(spark, SF001))
    index = IvfIndex.build(c.chunks(), nlist=4)
    q = spark.createDataFrame([(0, "the river"), (1, "a small house")],
                              "query_id long, text string")
    approx = sorted(tuple(r) for r in c.search(q, k=3, index=index, nprobe=4).collect())
    exact = sorted(tuple(r) for r in c.search(q, k=3).collect())
    assert approx == exact and len(exact) == 6


def test_search_strategies_agree(spark):
    from testdata_paths import SF001
    from quarry.operators import search as srch
    from quarry.plans.queries import doc_chunk_rows
    corpus = doc_chunk_rows(spark, SF001)
    q = spark.read.parquet(f"{SF001}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), "text")
    one = sorted(tuple(r) for r in srch.search(corpus, q, k=3).collect())
    many = sorted(tuple(r) for r in srch.search(corpus, q, k=3, strategy="broadcast").collect())
    assert one == many and len(one) == q.count() * 3


def test_numbering_does_not_depend_on_exchange_reuse(spark):
    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") * 7919 % 40_009).alias("k"), F.expr(
        "array_repeat(id, int(id % 4))").alias("a"))
    want = rows.agg(F.sum(F.size("a"))).first()[0]
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            got = assign_dense_ids(rows, ["k"], "a").agg(
                F.count("*"), F.countDistinct("idx"), F.min("idx"), F.max("idx")).first()
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        assert tuple(got) == (want, want, 1, want)


def test_append_chunks_by_name_alone_keeps_every_row(spark, tmp_path):
    c = Corpus.create(spark, f"{tmp_path}/named")
    ch = spark.createDataFrame([("doc1", "a"), ("doc1", "b"), ("doc2", "c"), ("doc2", "d")],
                               "doc_name string, chunk string")
    c.append_chunks(ch)
    rows = c.chunks().orderBy("idx").collect()
    assert [r["idx"] for r in rows] == [1, 2, 3, 4]
    assert sorted(r["chunk"] for r in rows) == ["a", "b", "c", "d"]
    assert [r["doc_name"] for r in rows] == ["doc1", "doc1", "doc2", "doc2"]


def test_repeated_and_null_document_ids_keep_every_row(spark, tmp_path):
    c = Corpus.create(spark, f"{tmp_path}/nulls")
    docs = spark.createDataFrame([(1, "a", "One."), (1, "b", "Two."), (None, "n", "Null.")],
                                 "doc_id long, doc_name string, text string")
    c.append_documents(docs)
    rows = c.chunks().orderBy("idx").collect()
    assert [r["idx"] for r in rows] == [1, 2, 3]
    assert rows[0]["doc_name"] == "n" and {r["doc_name"] for r in rows} == {"a", "b", "n"}


def test_a_rejected_replay_leaves_the_earlier_rows(spark, tmp_path):
    c = Corpus.create(spark, f"{tmp_path}/replay")
    good = spark.createDataFrame([(1, "x", 0, "x", [0.0] * 64)], c.chunks().schema)
    bad = spark.createDataFrame([(1, "x", 0, "x", [1.0])], c.chunks().schema)
    c._write(good, "b")
    with pytest.raises(ValueError):
        c._write(bad, "b")
    assert c.chunks().count() == 1 and c.next_idx() == 2
    c._write(good, "b")
    assert c.chunks().count() == 1 and c.commits().count() == 1


def test_an_append_writes_few_files(spark, tmp_path, monkeypatch):
    import glob
    from testdata_paths import SF01
    from quarry.plans import corpus as C
    from quarry.plans.queries import _named_docs
    monkeypatch.setattr(C, "IDX_BLOCK", 400)
    monkeypatch.setattr(C, "FILE_ROWS", 200)
    c = C.Corpus.create(spark, f"{tmp_path}/files")
    c.append_documents(_named_docs(spark, SF01).limit(600))
    n = c.chunks().count()
    files = glob.glob(f"{tmp_path}/files/chunks/batch=*/idx_block=*/*.parquet")
    assert len(files) <= n // 200 + 2


def test_appended_chunks_are_found_through_an_old_index(spark, tmp_path):
    from quarry.operators.ann import IvfIndex
    c = Corpus.create(spark, f"{tmp_path}/stale")
    make = lambda rows: spark.createDataFrame(
        rows, "doc_id long, doc_name string, text string")
    c.append_documents(make([(i, f"d{i}", f"Text number {i} about rivers.") for i in range(9)]))
    index = IvfIndex.build(c.chunks(), nlist=2)
    c.append_documents(make([(1, "new", "Quite another matter entirely.")]))
    q = spark.createDataFrame([(0, "Quite another matter entirely.")],
                              "query_id long, text string")
    assert c.search(q, k=1, index=index, nprobe=1).first()["doc_name"] == "new"


def test_load_checks_the_embedder_by_name(spark, tmp_path):
    from quarry.functions.embedders import trigram_embedder
    Corpus.create(spark, f"{tmp_path}/named_embedder")
    with pytest.raises(ValueError):
        Corpus.load(spark, f"{tmp_path}/named_embedder", trigram_embedder(64))


def test_text_files_by_odd_names(spark, tmp_path):
    import os
    for name in ("a b.txt", "c[1].txt", "d.txt"):
        (tmp_path / name).write_text(name)
    paths = [str(tmp_path / "a b.txt"), str(tmp_path / "c[1].txt"),
             os.path.relpath(tmp_path / "d.txt"), str(tmp_path / "d.txt"), f"file:{tmp_path}/d.txt", str(tmp_path / "none.txt")]
    got = [tuple(r) for r in read_text_docs(spark, paths, list("uvwxyz")).collect()]
    assert sorted((n, t) for n, _, t in got) == [
        ("u", "a b.txt"), ("v", "c[1].txt"), ("w", "d.txt"), ("x", "d.txt"), ("y", "d.txt"),
        ("z", "")]


def test_html_elements_in_general():
    from quarry.sources.html import parsed_texts
    assert parsed_texts("<div>a<div>b</div>c</div>", ["div"]) == ["a b c", "b"]
    assert parsed_texts("<ul><li>one<li>two</ul>", ["li"]) == ["one", "two"]
    assert parsed_texts("<p>caf&eacute; it&#8217;s &mdash;", ["p"]) == ["café it’s —"]
    assert parsed_texts("<h1>a</h2>b</h1><p>c<p>d<script>p</script>", ["h1", "p"]) == [
        "a b", "c", "d"]
    assert parsed_texts(None, ["p"]) == [] and parsed_texts("<td>x<td>y<tr><td>z", ["td"]) == [
        "x", "y", "z"]


def test_checkpoint_folder_is_needed_beyond_local_masters():
    from quarry.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError):
        checkpoint_dir(Session())
