"""Registry of the engine's queries over the driver tables: name -> (Spark fn, oracle SQL).

Every query reads whole tables (``documents``, ``embeddings``, ``pages``, ``conversations``,
``benchmark``, ``labels``) or data Spark derives from them. Doubles are rounded to 6 decimals
on both sides; every computed column carries the same alias in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import HashEmbedder, cosine_similarity, dot, l2_norm
from quarry.operators import chunking, generation as gen, knn as knn_ops, search as srch
from quarry.operators.numbering import assign_dense_ids, next_idx as next_idx_op
from quarry.operators.secrets import secret_scan
from quarry.operators.splitting import split_parts
from quarry.plans import oracle_sql as O
from quarry.plans.catalog import corpus_names
from quarry.plans.corpus import Corpus, chunk_rows
from quarry.session import checkpoint_dir, scratch_path, ship_package, spread
from quarry.sources import html as html_src, pages as pages_src

K_SEARCH = 5
K_KNN = 10
PAGES_PER_GROUP = 3
RANGE_FIRST, RANGE_LAST = 2, 4
SPLIT_PARTS = 3


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    checkpoint_dir(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf):
    return _t(spark, sf, "documents")


def _named_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast(
        "string")).alias("doc_name"), "text")


def _conv_pages(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page_no"),
                    "text")


def _r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------- text
def q_sentences(spark, sf):
    """Every sentence of every document with its position and token count."""
    return chunking.sentences(spread(_docs(spark, sf), "doc_id"))


def q_token_counts(spark, sf):
    """Per document: number of sentences and total token count."""
    return chunking.token_counts(spread(_docs(spark, sf), "doc_id"))


def q_chunk_numbers(spark, sf):
    """Per sentence: the chunk it lands in under greedy packing (limit 512)."""
    return chunking.chunk_numbers(spread(_docs(spark, sf), "doc_id"))


def q_chunkify(spark, sf):
    """Token-bounded chunks (limit 512) of every document."""
    return chunking.chunkify(spread(_docs(spark, sf), "doc_id"))


def q_embed_hash(spark, sf):
    """Hashing-embedder vector of every whole document text."""
    d = spread(_docs(spark, sf), "doc_id")
    return d.select("doc_id", HashEmbedder(64)(F.col("text")).alias("embedding"))


# --------------------------------------------------------------------------- corpus
def doc_chunk_rows(spark, sf) -> DataFrame:
    return chunk_rows(_named_docs(spark, sf), ["doc_id"], "doc_name", "text")


def q_assign_idx(spark, sf):
    """Dense idx 1..n over all chunks in (doc_id, chunk_no) order."""
    d = spread(_named_docs(spark, sf), "doc_id")
    chunked = chunking.with_chunks(d, "text").drop("text")
    return (assign_dense_ids(chunked, ["doc_id"], "_chunks", "idx", 0, "chunk_no")
            .select("idx", "doc_name", "chunk_no",
                    F.col("_chunks.n_tokens").alias("n_tokens")))


def q_ingest_documents(spark, sf):
    """Full corpus rows: chunk, number and embed every document."""
    return doc_chunk_rows(spark, sf)


def q_next_idx(spark, sf):
    """next_idx of the document corpus (max idx + 1)."""
    return next_idx_op(doc_chunk_rows(spark, sf).select("idx"))


def q_ingest_entries(spark, sf):
    """Conversations as lists of entries (one per turn) under one name each;
    chunks never cross entries."""
    c = _t(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))
        .alias("doc_name"), "text")
    d = spread(c, "conv_id")
    chunked = chunking.with_chunks(d, "text").drop("text")
    return (assign_dense_ids(chunked, ["conv_id", "turn"], "_chunks", "idx", 0, "chunk_no")
            .select("idx", "doc_name", F.col("turn").cast("int").alias("entry_no"), "chunk_no",
                    F.col("_chunks.chunk").alias("chunk")))


def q_upsert_chunks(spark, sf):
    """Chunks appended one batch at a time (English documents first, then the rest); each
    append numbers its rows from the corpus' ``next_idx``."""
    docs = _docs(spark, sf).select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast(
        "string")).alias("doc_name"), "text", "lang")
    chunks = chunking.chunkify(spread(docs, "doc_id"), id_cols=("doc_id", "doc_name", "lang"))
    corpus = Corpus.create(spark)
    order = ("doc_id", "chunk_no")
    corpus.append_chunks(chunks.where(F.col("lang") == "en"), order_cols=order)
    corpus.append_chunks(chunks.where(~F.col("lang").eqNullSafe("en")), order_cols=order)
    return corpus.chunks().select("idx", "doc_name", "chunk_no", "chunk")


def q_corpus_roundtrip(spark, sf):
    """Create a corpus (limit 256), append all documents, load it back."""
    corpus = Corpus.create(spark, max_seq_len=256)
    corpus.append_documents(_named_docs(spark, sf))
    loaded = Corpus.load(spark, corpus.path)
    return loaded.chunks().select(
        "idx", "doc_name", "chunk", F.lit(loaded.embedder.name).alias("embedder"),
        F.lit(loaded.max_seq_len).alias("max_seq_len"))


def q_ingest_mixed(spark, sf):
    """Documents and stored web pages (element text) in one corpus, documents
    first, duplicates kept."""
    docs = _named_docs(spark, sf).select(F.lit(0).alias("src"), F.col("doc_id").alias("key"),
                                         "doc_name", "text")
    pages = html_src.html_text(_t(spark, sf, "pages")).select(
        F.lit(1).alias("src"), F.col("page_id").alias("key"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("doc_name"), "text")
    both = spread(docs.unionByName(pages), "key")
    chunked = chunking.with_chunks(both, "text").drop("text")
    return (assign_dense_ids(chunked, ["src", "key"], "_chunks", "idx", 0, "chunk_no")
            .select("idx", "doc_name", "chunk_no", F.col("_chunks.chunk").alias("chunk")))


def q_lookup_idx(spark, sf):
    """Documents whose id is in the set of toxic-labelled ids (semi join)."""
    ids = _t(spark, sf, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("idx"))
    docs = _docs(spark, sf).select(F.col("doc_id").alias("idx"), "n_chars")
    return srch.lookup_idx(docs, ids).select(F.col("idx").alias("doc_id"), "n_chars")


# --------------------------------------------------------------------------- vectors
def _emb_corpus(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("idx"),
                    F.concat(F.lit("label_"), F.col("label").cast("string")).alias("doc_name"),
                    F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("chunk"),
                    "embedding")


def q_knn_exact(spark, sf):
    """Every embedding's 10 nearest embeddings (Euclidean, ties by lower id)."""
    e = _t(spark, sf, "embeddings")
    hits = knn_ops.knn(e.select(F.col("vec_id").alias("idx"), "embedding"),
                       e.select(F.col("vec_id").alias("query_id"), "embedding"), k=K_KNN)
    return hits.select("query_id", "rank", "idx", _r6(F.col("distance")).alias("distance"))


def q_knn_pivot(spark, sf):
    """As ``knn_exact``, by pivot cells: queries go to the cells that bounds cannot exclude."""
    rows, asked = _emb_tables(spark, sf)
    hits = knn_ops.knn(rows, asked, k=K_KNN, strategy="pivot")
    return hits.select("query_id", "rank", "idx", _r6(F.col("distance")).alias("distance"))


def _emb_hits(spark, sf, k=K_SEARCH):
    corpus = _emb_corpus(spark, sf)
    q = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return srch.attach_metadata(knn_ops.knn(corpus.select("idx", "embedding"), q, k=k), corpus)


def q_search_arrays(spark, sf):
    """Per query vector: top-5 ids, label names and distances as ordered arrays."""
    res = srch.collect_results(_emb_hits(spark, sf), with_chunks=False)
    return res.select("query_id", "idx_list", "doc_names",
                      F.transform("distances", lambda d: F.round(d, 6)).alias("distances"))


def q_citations(spark, sf):
    """Per query vector: distinct label names of its top-5 hits in rank order."""
    return srch.citations(srch.collect_results(_emb_hits(spark, sf), with_chunks=False))


def q_vector_norms(spark, sf):
    """L2 norm and self dot product of every embedding."""
    e = _t(spark, sf, "embeddings")
    return e.select("vec_id", _r6(l2_norm("embedding")).alias("norm"),
                    _r6(dot("embedding", "embedding")).alias("dot_self"))


def q_cosine_pairs(spark, sf):
    """Cosine similarity of every embedding with the next id."""
    e = _t(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    j = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return j.select("a_id", "b_id", _r6(cosine_similarity("a", "b")).alias("cosine"))


def doc_corpus(spark, sf) -> Corpus:
    """The documents as a stored corpus."""
    corpus = Corpus.create(spark)
    corpus.append_documents(_named_docs(spark, sf))
    return corpus


def _doc_search(spark, sf, queries: DataFrame, k: int = K_SEARCH, strategy: str = "grid"):
    return doc_corpus(spark, sf).search(queries, k=k, strategy=strategy)


def q_search_topk(spark, sf):
    """Benchmark questions searched over the document corpus: top-5 chunks."""
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = _doc_search(spark, sf, q, strategy="pivot")
    return hits.select("query_id", "rank", "idx", "doc_name", "chunk",
                       _r6(F.col("distance")).alias("distance"))


def q_rag_prompts(spark, sf):
    """Prompt per benchmark question with its top-5 chunks as context."""
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = _doc_search(spark, sf, q, strategy="pivot")
    ctx = srch.collect_results(hits).select("query_id", F.col("chunks").alias("context"))
    j = q.join(ctx, "query_id", "left")
    return j.select("query_id", gen.build_prompt(F.col("text"), F.col("context")).alias("prompt"))


# --------------------------------------------------------------------------- sources
def q_html_text(spark, sf):
    """Text of the h1/h2/p elements of every stored page."""
    return html_src.html_text(spread(_t(spark, sf, "pages"), "page_id"))


def q_page_groups(spark, sf):
    """Conversation turns as pages; groups of 3 pages concatenated."""
    return pages_src.page_groups(_conv_pages(spark, sf), pages_per_entry=PAGES_PER_GROUP)


def q_pages_each(spark, sf):
    """Conversation turns as pages; one entry per page."""
    return pages_src.pages_each(_conv_pages(spark, sf))


def q_page_range(spark, sf):
    """Conversation turns as pages; pages 2..4 of every conversation, clamped."""
    return pages_src.page_range(_conv_pages(spark, sf), RANGE_FIRST, RANGE_LAST)


def q_list_corpora(spark, sf):
    """Corpus names from the last path segment of every page URL."""
    files = _t(spark, sf, "pages").select(
        F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1).alias("file_name"))
    return corpus_names(files)


# --------------------------------------------------------------------------- generation
def _user_turns(spark, sf):
    return _t(spark, sf, "conversations").where(F.col("role") == "user")


def q_route_models(spark, sf):
    """Model, family and k for every user turn."""
    r = gen.route_models(_user_turns(spark, sf).select("conv_id", "turn"))
    return r.select("conv_id", "turn", "model", "family", "k")


def q_request_payloads(spark, sf):
    """JSON request body (no context) for every user turn."""
    r = gen.route_models(_user_turns(spark, sf).select("conv_id", "turn", "text"))
    return r.select("conv_id", "turn", "model",
                    gen.payload("model", "family", gen.build_prompt(F.col("text"))).alias("body"))


def synth_responses(spark, sf) -> DataFrame:
    """Reply table shaped like a batch-inference output, derived from assistant turns: the
    turn text is the reply; some rows carry a failed status or a cut-off body."""
    a = _t(spark, sf, "conversations").where(F.col("role") == "assistant")
    a = gen.route_models(a.select("conv_id", "turn", "text"))
    hosted = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content"))
                                                 .alias("message"))).alias("choices")))
    local = F.to_json(F.struct(F.col("text").alias("response")))
    n = F.length("text")
    cut = F.expr("substring(_b, 1, length(_b) - 1)")
    return (a.withColumn("_b", F.when(F.col("family") == "hosted", hosted).otherwise(local))
             .select("conv_id", "turn", "family",
                     F.when(n % 17 == 0, F.lit(503)).otherwise(F.lit(200)).alias("status"),
                     F.when(n % 11 == 0, cut).otherwise(F.col("_b")).alias("body")))


def q_parse_responses(spark, sf):
    """Parsed reply or error for every synthesised reply row."""
    return gen.parse_responses(synth_responses(spark, sf), id_cols=("conv_id", "turn"))


# --------------------------------------------------------------------------- misc
def q_paged_files(spark, sf):
    """Conversations written as paged text files and read back, in groups of pages."""
    from quarry.sources.paged_files import read_paged, write_paged
    path = scratch_path(spark, "paged")
    write_paged(_conv_pages(spark, sf), path)
    return pages_src.page_groups(read_paged(spark, path, "long"),
                                 pages_per_entry=PAGES_PER_GROUP)


def q_text_files(spark, sf):
    """Whole files as documents: every benchmark text is a file; of the names asked for, one
    per text has no file and is empty."""
    from quarry.sources.text_files import read_listed
    root = scratch_path(spark, "files")
    item = F.col("item_id").cast("string")
    texts = _t(spark, sf, "benchmark").select(item.alias("item"), F.coalesce(
        "text", F.lit("")).alias("value"))
    texts.repartition("item").write.partitionBy("item").text(root)
    # Spark names the files; the list takes them from a look at the folder
    names = (spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root)
             .select(F.regexp_extract("path", "(item=[^/]+/[^/]+)$", 1).alias("path")))
    there = names.select(F.regexp_extract("path", "item=([^/]+)", 1).alias("doc_name"), "path")
    gone = there.select(F.concat(F.lit("no_"), F.col("doc_name")).alias("doc_name"),
                        F.concat("path", F.lit(".gone")).alias("path"))
    return read_listed(there.unionByName(gone), root).select("doc_name", "text")


def q_append_text(spark, sf):
    """Texts of two tables appended to one text dataset: its lines, with how often they occur."""
    from quarry.operators.splitting import append_text
    path = scratch_path(spark, "appended")
    for name in ("documents", "benchmark"):
        append_text(_t(spark, sf, name).select(F.coalesce("text", F.lit("")).alias("value")), path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def q_split_parts(spark, sf):
    """Byte-balanced 3-way line parts of every document."""
    return split_parts(spread(_docs(spark, sf), "doc_id"), SPLIT_PARTS)


def q_secret_scan(spark, sf):
    """Key-like strings found in every document."""
    return secret_scan(spread(_docs(spark, sf), "doc_id"))


# --------------------------------------------------------------------------- registry
def _sql_sentences():
    return ("WITH " + O.sentences_cte("sents", "documents", ["doc_id"]) +
            " SELECT doc_id, sent_no, sentence, n_tokens FROM sents")


def _sql_chunks_select(select: str) -> str:
    return "WITH RECURSIVE " + O.chunk_pipeline("documents", ["doc_id"]) + " " + select


SQL = {
    "sentences": _sql_sentences(),
    "token_counts": "WITH " + O.sentences_cte("sents", "documents", ["doc_id"]) + """
  SELECT d.doc_id, CAST(count(s.sent_no) AS INTEGER) AS n_sentences,
         CAST(coalesce(sum(s.n_tokens), 0) AS BIGINT) AS n_tokens
  FROM documents d LEFT JOIN sents s USING (doc_id) GROUP BY d.doc_id""",
    "chunk_numbers": _sql_chunks_select(
        "SELECT doc_id, sent_no, CAST(chunk_no AS INTEGER) AS chunk_no, n_tokens FROM pack"),
    "chunkify": _sql_chunks_select("SELECT doc_id, chunk_no, chunk, n_tokens FROM chunks"),
    "embed_hash": "WITH " + O.embed_cte("e", "documents", ["doc_id"], "text") +
                  " SELECT doc_id, embedding FROM e",
    "assign_idx": _sql_chunks_select("""SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS idx,
        'doc_' || doc_id AS doc_name, chunk_no, n_tokens FROM chunks"""),
    "ingest_documents": "WITH RECURSIVE " + O.doc_corpus_ctes() +
                        " SELECT idx, doc_name, chunk_no, chunk, embedding FROM corpus",
    "next_idx": _sql_chunks_select(
        "SELECT CAST(coalesce(count(*), 0) + 1 AS BIGINT) AS next_idx FROM chunks"),
    "ingest_entries": "WITH RECURSIVE " + O.chunk_pipeline(
        "conversations", ["conv_id", "turn"]) + """
  SELECT row_number() OVER (ORDER BY conv_id, turn, chunk_no) AS idx, 'conv_' || conv_id AS doc_name,
         CAST(turn AS INTEGER) AS entry_no, chunk_no, chunk FROM chunks""",
    "upsert_chunks": "WITH RECURSIVE " + O.chunk_pipeline(
        "documents", ["doc_id", "lang"]) + """
  SELECT row_number() OVER (ORDER BY (lang IS DISTINCT FROM 'en'), doc_id, chunk_no) AS idx,
         'doc_' || doc_id AS doc_name, chunk_no, chunk FROM chunks""",
    "corpus_roundtrip": "WITH RECURSIVE " + O.chunk_pipeline(
        "documents", ["doc_id"], limit=256) + """
  SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS idx, 'doc_' || doc_id AS doc_name, chunk,
         'hash-md5-64' AS embedder, 256 AS max_seq_len FROM chunks""",
    "ingest_mixed": "WITH RECURSIVE " + """
  src AS (SELECT 0 AS src, doc_id AS key, 'doc_' || doc_id AS doc_name, text FROM documents
          UNION ALL
          SELECT 1 AS src, page_id AS key, 'page_' || page_id AS doc_name, ht.text FROM ht),
""" + O.chunk_pipeline("src", ["src", "key", "doc_name"]) + """
  SELECT row_number() OVER (ORDER BY src, key, chunk_no) AS idx, doc_name, chunk_no, chunk
  FROM chunks""",
    "lookup_idx": """SELECT doc_id, n_chars FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "knn_exact": f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, idx, round(d, 6) AS distance FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS idx,
         list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY
           list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.vec_id) AS rank
  FROM embeddings q, embeddings c) WHERE rank <= {K_KNN}""",
    "search_arrays": f"""SELECT query_id, list(idx ORDER BY rank) AS idx_list,
    list(doc_name ORDER BY rank) AS doc_names, list(round(d, 6) ORDER BY rank) AS distances
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS idx, 'label_' || c.label AS doc_name,
         list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY
           list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.vec_id) AS rank
        FROM embeddings q, embeddings c) WHERE rank <= {K_SEARCH} GROUP BY query_id""",
    "citations": f"""SELECT query_id, list_distinct_ordered AS doc_names FROM (
  SELECT query_id, list_reduce(list_transform(names, lambda x: [x]),
           lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END)
         AS list_distinct_ordered
  FROM (SELECT query_id, list(doc_name ORDER BY rank) AS names FROM (
    SELECT q.vec_id AS query_id, 'label_' || c.label AS doc_name,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY
             list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.vec_id) AS rank
    FROM embeddings q, embeddings c) WHERE rank <= {K_SEARCH} GROUP BY query_id))""",
    "vector_norms": """SELECT vec_id,
    round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
    round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS dot_self
  FROM embeddings""",
    "cosine_pairs": """SELECT a.vec_id AS a_id, b.vec_id AS b_id,
    round(CASE WHEN sqrt(list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x)))
                    * sqrt(list_sum(list_transform(b.embedding::DOUBLE[], lambda x: x * x))) = 0
               THEN 'NaN'::DOUBLE
               ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
                    / (sqrt(list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x)))
                       * sqrt(list_sum(list_transform(b.embedding::DOUBLE[], lambda x: x * x))))
          END, 6) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "search_topk": "WITH RECURSIVE " + O.doc_corpus_ctes() + ",\n" + O.embed_cte(
        "q", "benchmark", ["item_id"], "text") + f"""
  SELECT query_id, CAST(rank AS INTEGER) AS rank, idx, doc_name, chunk, round(d, 6) AS distance FROM (
    SELECT q.item_id AS query_id, c.idx, c.doc_name, c.chunk,
           list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d,
           row_number() OVER (PARTITION BY q.item_id ORDER BY
             list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.idx) AS rank
    FROM q, corpus c) WHERE rank <= {K_SEARCH}""",
    "rag_prompts": "WITH RECURSIVE " + O.doc_corpus_ctes() + ",\n" + O.embed_cte(
        "q", "benchmark", ["item_id"], "text") + f""",
  hits AS (SELECT query_id, chunk, rank FROM (
    SELECT q.item_id AS query_id, c.chunk,
           row_number() OVER (PARTITION BY q.item_id ORDER BY
             list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.idx) AS rank
    FROM q, corpus c) WHERE rank <= {K_SEARCH}),
  ctx AS (SELECT query_id, list(chunk ORDER BY rank) AS context FROM hits GROUP BY query_id)
  SELECT b.item_id AS query_id, {O.prompt_expr("b.text", "ctx.context")} AS prompt
  FROM benchmark b LEFT JOIN ctx ON ctx.query_id = b.item_id""",
    "page_groups": f"""SELECT conv_id AS doc, CAST(floor(turn / {PAGES_PER_GROUP}) AS INTEGER) AS entry_no,
    min(turn + 1) AS first_page, string_agg(text, '' ORDER BY turn) AS text
  FROM conversations WHERE text IS NOT NULL GROUP BY ALL""",
    "pages_each": """SELECT conv_id AS doc, CAST(turn AS INTEGER) AS entry_no, turn + 1 AS first_page, text
  FROM conversations WHERE text IS NOT NULL""",
    "page_range": f"""WITH n AS (SELECT conv_id, max(turn + 1) AS n FROM conversations GROUP BY conv_id),
  b AS (SELECT conv_id, least(greatest({RANGE_FIRST}, 1), least({RANGE_LAST}, n)) AS first_page,
               greatest(greatest({RANGE_FIRST}, 1), least({RANGE_LAST}, n)) AS last_page FROM n)
  SELECT c.conv_id AS doc, b.first_page, b.last_page, string_agg(c.text, '' ORDER BY c.turn) AS text
  FROM conversations c JOIN b USING (conv_id)
  WHERE c.text IS NOT NULL AND c.turn + 1 BETWEEN b.first_page AND b.last_page
  GROUP BY c.conv_id, b.first_page, b.last_page""",
    "list_corpora": r"""SELECT DISTINCT regexp_replace(regexp_replace(
      regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1), '^(.+)\.[^.]+$', '\1'), '_data$', '')
    AS corpus_name FROM pages
  WHERE regexp_replace(regexp_replace(regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1),
        '^(.+)\.[^.]+$', '\1'), '_data$', '') <> '.DS_Store'""",
    "split_parts": "",  # filled below
    "secret_scan": "",  # filled below
}


def _models_values() -> str:
    from quarry.sources.models import DEFAULT_MODELS
    rows = ", ".join(f"({i}, '{m}')" for i, m in enumerate(DEFAULT_MODELS))
    return f"(VALUES {rows}) AS m(model_no, model)"


def _route_sql(cols: str, where: str) -> str:
    n = 3
    return f"""SELECT {cols}, m.model,
    CASE WHEN instr(m.model, '{gen.HOSTED_MARKER}') > 0 THEN 'hosted' ELSE 'local' END AS family
  FROM conversations c JOIN {_models_values()} ON m.model_no = (c.conv_id % {n})
  WHERE {where}"""


SQL["route_models"] = f"""SELECT conv_id, turn, model, family,
    CASE WHEN family = 'hosted' THEN {gen.HOSTED_K} ELSE {gen.LOCAL_K} END AS k
  FROM ({_route_sql("c.conv_id, c.turn", "c.role = 'user'")})"""

SQL["request_payloads"] = f"""SELECT conv_id, turn, model,
    CASE WHEN family = 'hosted' THEN
      to_json({{'model': regexp_replace(model, '^openai:', ''), 'temperature': {gen.TEMPERATURE}::DOUBLE,
                'messages': [{{'role': 'user', 'content': {O.prompt_expr("text", None)}}}]}})::VARCHAR
    ELSE
      to_json({{'model': model, 'stream': false, 'prompt': {O.prompt_expr("text", None)},
                'options': {{'temperature': {gen.TEMPERATURE}::DOUBLE,
                             'repeat_penalty': {gen.REPEAT_PENALTY}::DOUBLE}}}})::VARCHAR
    END AS body
  FROM ({_route_sql("c.conv_id, c.turn, c.text", "c.role = 'user'")})"""

SQL["parse_responses"] = f"""WITH r AS ({_route_sql("c.conv_id, c.turn, c.text", "c.role = 'assistant'")}),
  b AS (SELECT conv_id, turn, family, length(text) AS n,
          CASE WHEN family = 'hosted'
               THEN to_json({{'choices': [{{'message': {{'content': text}}}}]}})::VARCHAR
               ELSE to_json({{'response': text}})::VARCHAR END AS b0 FROM r),
  x AS (SELECT conv_id, turn, family, CASE WHEN n % 17 = 0 THEN 503 ELSE 200 END AS status,
          CASE WHEN n % 11 = 0 THEN substring(b0, 1, length(b0) - 1) ELSE b0 END AS body FROM b),
  y AS (SELECT *, CASE WHEN NOT json_valid(body) THEN NULL
                       WHEN family = 'hosted' THEN json_extract_string(body, '$.choices[0].message.content')
                       ELSE json_extract_string(body, '$.response') END AS txt FROM x)
  SELECT conv_id, turn, status, CASE WHEN status = 200 THEN txt END AS result,
    CASE WHEN status <> 200 THEN 'request failed with status ' || status
         WHEN txt IS NULL THEN 'malformed reply' END AS error
  FROM y"""

SQL["ingest_mixed"] = SQL["ingest_mixed"].replace(
    "WITH RECURSIVE \n  src AS",
    "WITH RECURSIVE " + "ht AS (SELECT page_id, " + "__HTML__" + " AS text FROM pages),\n  src AS")

SQL["split_parts"] = f"""WITH RECURSIVE
  d AS (SELECT doc_id, text, strlen(text) AS size,
          CASE WHEN length(text) = 0 THEN []::VARCHAR[]
               WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[1:-2]
               ELSE string_split(text, chr(10)) END AS lines FROM documents),
  l AS (SELECT doc_id, CAST(floor(size / {SPLIT_PARTS}) AS BIGINT) AS target, i - 1 AS line_no,
          strlen(lines[i]) + 1 AS cost
        FROM (SELECT doc_id, size, lines, generate_subscripts(lines, 1) AS i FROM d)),
  r AS (SELECT doc_id, line_no, cost, target,
          CASE WHEN cost >= target THEN 0 ELSE cost END AS acc,
          0 AS part, CASE WHEN cost >= target THEN 1 ELSE 0 END AS closed
        FROM l WHERE line_no = 0
        UNION ALL
        SELECT l.doc_id, l.line_no, l.cost, l.target,
          CASE WHEN r.acc + l.cost >= l.target THEN 0 ELSE r.acc + l.cost END,
          r.part + r.closed,
          CASE WHEN r.acc + l.cost >= l.target THEN 1 ELSE 0 END
        FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no = r.line_no + 1)
  SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(min(line_no) AS INTEGER) AS first_line,
         CAST(count(*) AS INTEGER) AS n_lines, CAST(sum(cost) AS BIGINT) AS n_bytes
  FROM r GROUP BY doc_id, part"""

def _secret_sql() -> str:
    from quarry.operators.secrets import SECRET_PATTERNS
    parts = [f"""SELECT doc_id, '{kind}' AS kind,
      list_filter(regexp_extract_all(text, '{cand}', 1), lambda h: regexp_matches(h, '{fmt}'))
      AS hits FROM documents""" for kind, cand, fmt in SECRET_PATTERNS]
    return ("WITH k AS (" + " UNION ALL ".join(parts) + """)
  SELECT doc_id, kind, CAST(i - 1 AS INTEGER) AS hit_no, hits[i] AS secret
  FROM (SELECT doc_id, kind, hits, generate_subscripts(hits, 1) AS i FROM k)""")


SQL["secret_scan"] = _secret_sql()


def _html_sql(col: str = "html") -> str:
    from quarry.sources.html import DEFAULT_ELEMENTS, ENTITIES
    names = "|".join(DEFAULT_ELEMENTS)
    cleaned = (f"regexp_replace({col}, '<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>',"
               f" '', 'gis')")
    closed = (f"regexp_replace({cleaned}, '(<p[\\s>]|<h[1-6][\\s>]|</(?:article|div|body|section|main)>"
              f"|<footer[\\s>])', '</p>\\1', 'gi') || '</p>'")
    matches = f"regexp_extract_all({closed}, '(?is)<(?:{names})(?:\\s[^>]*)?>.*?</(?:{names})>')"
    m = "regexp_replace(m, '<[^>]*>', ' ', 'g')"
    for ent, ch in ENTITIES:
        esc = ch.replace("'", "''")
        m = f"replace({m}, '{ent}', '{esc}')"
    per = f"trim(regexp_replace({m}, '\\s+', ' ', 'g'))"
    return (f"array_to_string(list_filter(list_transform({matches}, lambda m: {per}),"
            f" lambda t: t <> ''), ' ')")


SQL["html_text"] = f"SELECT page_id, {_html_sql()} AS text FROM pages"
SQL["ingest_mixed"] = SQL["ingest_mixed"].replace("__HTML__", _html_sql())


QUERIES = {
    "sentences": q_sentences,
    "token_counts": q_token_counts,
    "chunk_numbers": q_chunk_numbers,
    "chunkify": q_chunkify,
    "embed_hash": q_embed_hash,
    "assign_idx": q_assign_idx,
    "ingest_documents": q_ingest_documents,
    "next_idx": q_next_idx,
    "ingest_entries": q_ingest_entries,
    "upsert_chunks": q_upsert_chunks,
    "corpus_roundtrip": q_corpus_roundtrip,
    "ingest_mixed": q_ingest_mixed,
    "lookup_idx": q_lookup_idx,
    "knn_exact": q_knn_exact,
    "knn_pivot": q_knn_pivot,
    "search_arrays": q_search_arrays,
    "citations": q_citations,
    "vector_norms": q_vector_norms,
    "cosine_pairs": q_cosine_pairs,
    "search_topk": q_search_topk,
    "rag_prompts": q_rag_prompts,
    "html_text": q_html_text,
    "page_groups": q_page_groups,
    "pages_each": q_pages_each,
    "page_range": q_page_range,
    "list_corpora": q_list_corpora,
    "route_models": q_route_models,
    "request_payloads": q_request_payloads,
    "parse_responses": q_parse_responses,
    "split_parts": q_split_parts,
    "secret_scan": q_secret_scan,
    "paged_files": q_paged_files,
    "text_files": q_text_files,
    "append_text": q_append_text,
}


# --------------------------------------------------------------------------- approximate
IVF_NPROBE = 4
#: cells at most: the centroids are held by the driver and every task
IVF_NLIST = 256


def _emb_tables(spark, sf):
    e = _t(spark, sf, "embeddings")
    return (e.select(F.col("vec_id").alias("idx"), "embedding"),
            e.select(F.col("vec_id").alias("query_id"), "embedding"))


def label_centroids(spark, sf):
    """The vector of lowest id of each label, for the ``IVF_NLIST`` lowest labels."""
    e = _t(spark, sf, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL")
    rows = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).orderBy("label").limit(
        IVF_NLIST)
    return [list(r["c"]) for r in rows.collect()]


def _ivf_hits(index, q):
    hits = index.search(q, k=K_KNN, nprobe=IVF_NPROBE)
    return hits.select("query_id", "rank", "idx", _r6(F.col("distance")).alias("distance"))


def q_knn_ivf(spark, sf):
    """Every embedding's 10 nearest via IVF (a cell per label, 4 probed)."""
    from quarry.operators.ann import IvfIndex
    corpus, q = _emb_tables(spark, sf)
    return _ivf_hits(IvfIndex.build(corpus, centroids=label_centroids(spark, sf)), q)


def q_ivf_refresh(spark, sf):
    """Index built on a first batch (labels 0-4), the rest added to the same cells, then every
    vector searched."""
    from quarry.operators.ann import IvfIndex
    corpus, q = _emb_tables(spark, sf)
    e = _t(spark, sf, "embeddings").withColumnRenamed("vec_id", "idx")
    early = F.coalesce(F.col("label") < 5, F.lit(False))
    index = IvfIndex.build(e.where(early), centroids=label_centroids(spark, sf))
    return _ivf_hits(index.refresh(e.where(~early)), q)


def _ivf_sql() -> str:
    d = "list_distance(v.embedding::DOUBLE[], c.e)"
    return f"""WITH v AS (SELECT vec_id, label, embedding FROM embeddings
             WHERE embedding IS NOT NULL),
  c AS (SELECT row_number() OVER (ORDER BY label) AS cell, min_by(embedding, vec_id)::DOUBLE[] AS e
        FROM v WHERE label IS NOT NULL GROUP BY label ORDER BY label LIMIT {IVF_NLIST}),
  near AS (SELECT vec_id, cell, n FROM (SELECT v.vec_id, c.cell,
             row_number() OVER (PARTITION BY v.vec_id ORDER BY {d}, c.cell) AS n
           FROM v, c) WHERE n <= {IVF_NPROBE}),
  pairs AS (SELECT q.vec_id AS query_id, r.vec_id AS idx FROM near q JOIN near r
              ON r.cell = q.cell AND r.n = 1),
  hits AS (SELECT p.query_id, p.idx, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
           FROM pairs p JOIN v a ON a.vec_id = p.query_id JOIN v b ON b.vec_id = p.idx),
  ranked AS (SELECT query_id, idx, d, row_number() OVER (PARTITION BY query_id ORDER BY d, idx) AS r
             FROM hits)
  SELECT query_id, CAST(r AS INTEGER) AS rank, idx, round(d, 6) AS distance FROM ranked
  WHERE r <= {K_KNN}"""


SQL["knn_ivf"] = SQL["ivf_refresh"] = _ivf_sql()
SQL["knn_pivot"] = SQL["knn_exact"]
SQL["paged_files"] = SQL["page_groups"]
SQL["text_files"] = """SELECT CAST(item_id AS VARCHAR) AS doc_name,
    coalesce(text, '') || chr(10) AS text FROM benchmark
  UNION ALL SELECT 'no_' || item_id, '' FROM benchmark"""
SQL["append_text"] = """SELECT line, count(*) AS n FROM (
    SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
    UNION ALL SELECT unnest(string_split(coalesce(text, ''), chr(10))) FROM benchmark)
  GROUP BY line"""


#: tables, bits, bucket width and probed buckets of ``knn_lsh``
LSH = {"tables": 16, "bits": 6, "width": 2.0}
LSH_PROBES = 9


def q_knn_lsh(spark, sf):
    """Every embedding's 10 nearest among the rows of its probed buckets."""
    from quarry.operators.lsh import LshIndex
    rows, asked = _emb_tables(spark, sf)
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    hits = LshIndex.build(rows, dim, **LSH).search(asked, K_KNN, LSH_PROBES)
    return hits.select("query_id", "rank", "idx", _r6(F.col("distance")).alias("distance"))


def _lsh_sql() -> str:
    byte = lambda i: f"('0x' || substr(h, {2 * i + 1}, 2))::INTEGER"
    component = f"({' + '.join(byte(i) for i in range(4))} - 510)"
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
             WHERE embedding IS NOT NULL),
  c AS (SELECT t, m, d, {component} AS c FROM (
          SELECT t, m, d, md5(t || ':' || m || ':' || d) AS h
          FROM range({LSH['tables']}) a(t), range({LSH['bits']}) b(m),
               range(-1, (SELECT max(len(e)) FROM v)) f(d))),
  p AS (SELECT t, m, list(c::DOUBLE ORDER BY d) FILTER (d >= 0) AS a,
          max(((c % 1000) + 1000) % 1000) FILTER (d < 0) / 1000.0::DOUBLE * {LSH['width']} AS b
        FROM c GROUP BY t, m),
  y AS (SELECT vec_id, t, m, (list_dot_product(e, a) / 147.8::DOUBLE + b)
          / {LSH['width']}::DOUBLE AS y FROM v, p),
  own AS (SELECT vec_id, t, list(floor(y)::BIGINT ORDER BY m) AS cell FROM y GROUP BY vec_id, t),
  gaps AS (SELECT vec_id, t, m, 1 AS up, 1 - (y - floor(y)) AS gap FROM y
           UNION ALL SELECT vec_id, t, m, 0, y - floor(y) FROM y),
  moves AS (SELECT vec_id, t, m, up FROM (SELECT *, row_number() OVER (
              PARTITION BY vec_id, t ORDER BY gap, 2 * m + up) AS n FROM gaps)
            WHERE n < {LSH_PROBES}),
  probes AS (SELECT vec_id, t, cell FROM own UNION ALL
             SELECT vec_id, t, list_transform(cell, lambda x, i:
               CASE WHEN i = m + 1 THEN x + 2 * up - 1 ELSE x END) FROM moves JOIN own
               USING (vec_id, t)),
  pairs AS (SELECT DISTINCT q.vec_id AS query_id, r.vec_id AS idx
            FROM probes q JOIN own r ON r.t = q.t AND r.cell = q.cell),
  hits AS (SELECT query_id, idx, list_distance(a.e, b.e) AS d FROM pairs
           JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = idx),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, idx) AS r FROM hits)
  SELECT query_id, CAST(r AS INTEGER) AS rank, idx, round(d, 6) AS distance FROM ranked
  WHERE r <= {K_KNN}"""


SQL["knn_lsh"] = _lsh_sql()


#: stretches, code vectors and re-ranked rows of ``knn_pq``
PQ_STRETCHES, PQ_CODES, PQ_RERANK = 16, 16, 100


def q_knn_pq(spark, sf):
    """Every embedding's 10 nearest by product quantisation; the code vectors are those of the
    vectors of lowest id."""
    import numpy as np

    from quarry.operators.pq import PqIndex
    rows, asked = _emb_tables(spark, sf)
    first = rows.where("embedding IS NOT NULL").orderBy("idx").limit(PQ_CODES).collect()
    books = np.array([r["embedding"] for r in first], float)
    books = books.reshape(len(first), PQ_STRETCHES, -1).transpose(1, 0, 2)
    hits = PqIndex.build(rows, books).search(asked, K_KNN, PQ_RERANK)
    return hits.select("query_id", "rank", "idx", _r6(F.col("distance")).alias("distance"))


def _pq_sql() -> str:
    cut = lambda e: f"{e}[j * w + 1:j * w + w]"
    square = lambda a, b: (f"list_sum(list_transform(list_zip({a}, {b}), "  # noqa: E731
                           "lambda p: (p[1] - p[2]) * (p[1] - p[2])))")
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) // {PQ_STRETCHES} AS w
             FROM embeddings WHERE embedding IS NOT NULL),
  book AS (SELECT row_number() OVER (ORDER BY vec_id) AS c, e FROM v
           ORDER BY vec_id LIMIT {PQ_CODES}),
  near AS (SELECT vec_id, j, c, {square(cut('v.e'), cut('book.e'))} AS d
           FROM v, book, range({PQ_STRETCHES}) r(j)),
  code AS (SELECT vec_id AS idx, j, arg_min(c, (d, c)) AS c FROM near GROUP BY vec_id, j),
  told AS (SELECT n.vec_id AS query_id, idx, sum(d) AS d FROM near n JOIN code USING (j, c)
           GROUP BY query_id, idx),
  best AS (SELECT query_id, idx FROM (SELECT *, row_number() OVER (
             PARTITION BY query_id ORDER BY d, idx) AS n FROM told) WHERE n <= {PQ_RERANK}),
  hits AS (SELECT query_id, idx, list_distance(a.e, b.e) AS d FROM best
           JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = idx),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, idx) AS r FROM hits)
  SELECT query_id, CAST(r AS INTEGER) AS rank, idx, round(d, 6) AS distance FROM ranked
  WHERE r <= {K_KNN}"""


SQL["knn_pq"] = _pq_sql()


def q_split_long(spark, sf):
    """As ``split_parts``, with the lines of all documents dealt over the tasks."""
    from quarry.operators.long_text import split_lines
    from quarry.operators.splitting import text_lines
    lines = _docs(spark, sf).select(
        "doc_id", F.octet_length("text").alias("size"),
        F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    parts = split_lines(lines.select(F.col("doc_id").alias("doc"), "pos", "size", (
        F.octet_length("line") + 1).alias("cost")), SPLIT_PARTS)
    return parts.withColumnRenamed("doc", "doc_id")


def q_chunk_long(spark, sf):
    """Tokens of every chunk, with the sentences of all documents dealt over the tasks."""
    from quarry.operators.long_text import pack_sentences
    rows = chunking.sentences(spread(_docs(spark, sf), "doc_id"))
    packed = pack_sentences(rows.select(F.col("doc_id").alias("doc"), F.col("sent_no").alias(
        "pos"), F.col("n_tokens").alias("cost")), O.LIMIT)
    return packed.select(F.col("doc").alias("doc_id"), "chunk_no", "n_tokens")


SQL["split_long"] = SQL["split_parts"]
SQL["chunk_long"] = "WITH RECURSIVE " + O.chunk_pipeline("documents", ["doc_id"]) + """
  SELECT doc_id, chunk_no, n_tokens FROM chunks"""


def q_l2_pairs(spark, sf):
    """Euclidean distance of every embedding to the next id."""
    from quarry.functions.vectors import l2_distance
    e = _t(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    j = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return j.select("a_id", "b_id", _r6(l2_distance("a", "b")).alias("distance"))


SQL["l2_pairs"] = """SELECT a.vec_id AS a_id, b.vec_id AS b_id,
    round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


# --------------------------------------------------------------------------- streaming
def q_stream_ingest(spark, sf):
    """Documents ingested through Structured Streaming (equals batch ingest)."""
    from quarry.streaming.ingest import ingest_stream
    corpus = Corpus.create(spark)

    def to_docs(batch):
        return batch.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
                            .alias("doc_name"), "text")

    ingest_stream(spark, f"{sf}/documents.parque*", corpus, to_docs)
    return corpus.chunks()


# --------------------------------------------------------------------------- plug-ins
STREAM_CELLS = 8


def q_index_stream(spark, sf):
    """Cells of all chunks in an index that followed its corpus' commits as a stream: built on
    the documents of even id, which come first, around the first chunks' vectors."""
    from quarry.operators.ann import IvfIndex
    from quarry.streaming.index import follow
    corpus, docs = Corpus.create(spark), _named_docs(spark, sf)
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    corpus.append_documents(docs.where(even), batch="first")
    rows = corpus.chunks().select("idx", "embedding")
    centres = [list(r[0]) for r in rows.where(F.col("idx") <= STREAM_CELLS).orderBy("idx").select(
        "embedding").collect()]
    path = scratch_path(spark, "followed")
    IvfIndex.build(rows, centroids=centres).save(path)
    corpus.append_documents(docs.where(~even), batch="second")
    follow(corpus, path)
    return IvfIndex.load(spark, path).assigned.select("idx", "cell")


def q_custom_embedder(spark, sf):
    """Document chunks embedded with the pandas_udf trigram plug-in."""
    from quarry.functions.embedders import trigram_embedder
    emb = trigram_embedder(64)
    rows = chunk_rows(_named_docs(spark, sf), ["doc_id"], "doc_name", "text", embedder=emb)
    return rows.select("idx", "doc_name", "chunk_no", "embedding")


def _custom_embedder_sql() -> str:
    return "WITH RECURSIVE " + O.chunk_pipeline("documents", ["doc_id"]) + """,
  g AS (SELECT doc_id, chunk_no, '  ' || lower(chunk) || ' ' AS s FROM chunks),
  b AS (SELECT doc_id, chunk_no, list_transform(range(1, length(s) - 1), lambda i:
          CAST(('0x' || substr(md5(substr(s, i, 3)), 1, 8))::BIGINT % 64 AS INTEGER)) AS bk FROM g),
  n AS (SELECT doc_id, chunk_no, list_transform(range(64), lambda k:
          CAST(len(list_filter(bk, lambda x: x = k)) AS DOUBLE)) AS c FROM b)
  SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS idx, 'doc_' || doc_id AS doc_name,
    chunk_no, list_transform(c, lambda x: CAST(x / sqrt(list_sum(list_transform(c,
      lambda y: y * y))) AS FLOAT)) AS embedding
  FROM n"""


SQL["custom_embedder"] = _custom_embedder_sql()
SQL["index_stream"] = "WITH RECURSIVE " + O.doc_corpus_ctes().replace(
    "ORDER BY c.doc_id, c.chunk_no", "ORDER BY c.doc_id % 2, c.doc_id, c.chunk_no") + f""",
  d AS (SELECT r.idx, c.idx - 1 AS cell,
          list_distance(r.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d
        FROM corpus r JOIN corpus c ON c.idx <= {STREAM_CELLS})
  SELECT idx, CAST(arg_min(cell, (d, cell)) AS INTEGER) AS cell FROM d GROUP BY idx"""


def q_html_elements(spark, sf):
    """Text of the title and list items of every stored page, by the HTML parser."""
    return html_src.html_text(spread(_t(spark, sf, "pages"), "page_id"),
                              elements=HTML_ELEMENTS)


HTML_ELEMENTS = ("title", "li")


def _html_elements_sql() -> str:
    names = "|".join(HTML_ELEMENTS)
    m = "regexp_replace(m, '<[^>]*>', ' ', 'g')"
    for ent, ch in html_src.ENTITIES:
        m = "replace({}, '{}', '{}')".format(m, ent, ch.replace("'", "''"))
    per = f"trim(regexp_replace({m}, '\\s+', ' ', 'g'))"
    found = f"regexp_extract_all(html, '(?s)<(?:{names})>.*?</(?:{names})>')"
    return (f"SELECT page_id, array_to_string(list_filter(list_transform({found}, lambda m: {per}),"
            " lambda t: t <> ''), ' ') AS text FROM pages")


SQL["html_elements"] = _html_elements_sql()


def q_split_files(spark, sf):
    """Documents split in parts, written as text by part and read back: lines and bytes."""
    from quarry.operators.splitting import read_parts, write_parts
    path = scratch_path(spark, "parts")
    write_parts(_docs(spark, sf), SPLIT_PARTS, path)
    return read_parts(spark, path).groupBy("part").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.octet_length("line") + 1).cast("long").alias("n_bytes"))


SQL["split_files"] = f"""SELECT part, CAST(sum(n_lines) AS BIGINT) AS n_lines,
    CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM ({SQL["split_parts"]}) GROUP BY part"""


# --------------------------------------------------------------------------- answers
def turn_key(turn):
    """Text key of a conversation's turn; unlike a sum it cannot collide."""
    return F.concat_ws(":", "conv_id", turn)


def _user_queries(spark, sf):
    u = _user_turns(spark, sf)
    return u.select(turn_key(F.col("turn")).alias("query_id"), "conv_id", "text")


def q_answers(spark, sf):
    """User turns are questions; the next assistant turn is the model reply. Each question is
    routed to a model (k = 10 hosted, 3 local), searched over the document corpus, and ok
    replies become answer rows with their retrieved context."""
    qs = gen.route_models(_user_queries(spark, sf))
    hits = _doc_search(spark, sf, qs.select("query_id", "text"), k=gen.HOSTED_K)
    kept = hits.join(qs.select("query_id", "k"), "query_id") \
        .where(F.col("rank") <= F.col("k")).drop("k")
    results = srch.collect_results(kept)
    replies = synth_responses(spark, sf).select(
        turn_key(F.col("turn") - 1).alias("query_id"), "family", "status", "body")
    parsed = gen.parse_responses(replies.join(qs.select("query_id"), "query_id", "left_semi"))
    return gen.answers(parsed, results).select("query_id", "result", "idx_list", "doc_names",
                                               "chunks", "served")


def q_rag_payloads(spark, sf):
    """Request body with retrieved context for every user turn (k by the routed family)."""
    from quarry.plans.rag import rag_payloads
    return rag_payloads(doc_corpus(spark, sf).chunks(with_block=True), _user_queries(spark, sf))


SQL["stream_ingest"] = SQL["ingest_documents"]

SQL["rag_payloads"] = "WITH RECURSIVE " + O.doc_corpus_ctes() + f""",
  uq AS (SELECT conv_id || ':' || turn AS query_id, conv_id, text FROM conversations
         WHERE role = 'user'),
""" + O.embed_cte("q", "uq", ["query_id", "conv_id"], "text") + f""",
  qk AS (SELECT uq.query_id, uq.text, m.model,
           CASE WHEN instr(m.model, '{gen.HOSTED_MARKER}') > 0 THEN 'hosted' ELSE 'local' END AS family,
           CASE WHEN instr(m.model, '{gen.HOSTED_MARKER}') > 0
                THEN {gen.HOSTED_K} ELSE {gen.LOCAL_K} END AS k
         FROM uq JOIN {_models_values()} ON m.model_no = (uq.conv_id % 3)),
  hits AS (SELECT q.query_id, c.chunk,
             row_number() OVER (PARTITION BY q.query_id ORDER BY
               list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.idx) AS rank
           FROM q, corpus c),
  ctx AS (SELECT h.query_id, list(h.chunk ORDER BY h.rank) AS context
          FROM hits h JOIN qk USING (query_id) WHERE h.rank <= qk.k GROUP BY h.query_id),
  pr AS (SELECT qk.query_id, qk.model, qk.family, qk.k,
           {O.prompt_expr("qk.text", "ctx.context")} AS prompt
         FROM qk LEFT JOIN ctx USING (query_id))
  SELECT query_id, model, k,
    CASE WHEN family = 'hosted' THEN
      to_json({{'model': regexp_replace(model, '^openai:', ''), 'temperature': {gen.TEMPERATURE}::DOUBLE,
                'messages': [{{'role': 'user', 'content': prompt}}]}})::VARCHAR
    ELSE
      to_json({{'model': model, 'stream': false, 'prompt': prompt,
                'options': {{'temperature': {gen.TEMPERATURE}::DOUBLE,
                             'repeat_penalty': {gen.REPEAT_PENALTY}::DOUBLE}}}})::VARCHAR
    END AS body
  FROM pr"""

SQL["answers"] = "WITH RECURSIVE " + O.doc_corpus_ctes() + f""",
  uq AS (SELECT conv_id || ':' || turn AS query_id, conv_id, text FROM conversations
         WHERE role = 'user'),
""" + O.embed_cte("q", "uq", ["query_id", "conv_id"], "text") + f""",
  qk AS (SELECT query_id, CASE WHEN instr(m.model, '{gen.HOSTED_MARKER}') > 0
                     THEN {gen.HOSTED_K} ELSE {gen.LOCAL_K} END AS k
         FROM uq JOIN {_models_values()} ON m.model_no = (uq.conv_id % 3)),
  hits AS (SELECT q.query_id, c.idx, c.doc_name, c.chunk,
             row_number() OVER (PARTITION BY q.query_id ORDER BY
               list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.idx) AS rank
           FROM q, corpus c),
  arrays AS (SELECT h.query_id, list(h.idx ORDER BY h.rank) AS idx_list,
               list(h.doc_name ORDER BY h.rank) AS doc_names, list(h.chunk ORDER BY h.rank) AS chunks
             FROM hits h JOIN qk USING (query_id) WHERE h.rank <= qk.k GROUP BY h.query_id),
  parsed AS ({SQL["parse_responses"].replace("WITH r AS", "SELECT * FROM (WITH r AS", 1)})),
  replies AS (SELECT conv_id || ':' || (turn - 1) AS query_id, result, error FROM parsed
              WHERE conv_id || ':' || (turn - 1) IN (SELECT query_id FROM uq))
  SELECT r.query_id, r.result, a.idx_list, a.doc_names, a.chunks,
    to_json({{'result': r.result,
             'doc_names': list_reduce(list_transform(a.doc_names, lambda x: [x]),
               lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc
                                   ELSE list_concat(acc, x) END)}})::VARCHAR AS served
  FROM replies r LEFT JOIN arrays a USING (query_id) WHERE r.error IS NULL"""

QUERIES.update({
    "l2_pairs": q_l2_pairs,
    "html_elements": q_html_elements,
    "split_files": q_split_files,
    "knn_ivf": q_knn_ivf,
    "ivf_refresh": q_ivf_refresh,
    "stream_ingest": q_stream_ingest,
    "custom_embedder": q_custom_embedder,
    "index_stream": q_index_stream,
    "knn_lsh": q_knn_lsh,
    "knn_pq": q_knn_pq,
    "split_long": q_split_long,
    "chunk_long": q_chunk_long,
    "answers": q_answers,
    "rag_payloads": q_rag_payloads,
})
