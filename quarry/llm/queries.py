"""Queries over the given tables, one per operator, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (lattice, licenses, lines, mtree, packing, pieces, prefix_trie,
                        resampling, secret_crf, simhash, substrings, toxicity, url_filter)
from quarry.llm.shared import Scratch, table


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document and the text they decode to, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of 2,048 tokens without two of one source or cluster."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document once all repeated 200-byte strings are removed."""
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"),
                          lambda n, s: n + (s.end - s.start).cast("long"))
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op4_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents: counts of the base kinds, their digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_crf.scan(docs, secret_crf.learn(docs))
    told = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("secrets", lambda s: s.kind != "crf")
    count = lambda k: F.size(F.filter("secrets", lambda s: s.kind == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_crf.KINDS[:3]],
                        F.sha2(told(base), 256).alias("base_sha256"),
                        told(F.col("secrets")).alias("spans"))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.9 or more, their components and the kept ones."""
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that repeat, exactly or nearly, an earlier line."""
    return lines.mark_lines(table(spark, sf_dir, "documents"), **lines.WHOLE)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 4-word shingles, at most 4 differing bits."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score",
                                              "predicted", "passages")


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule",
                                                       "verdict")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of all documents: base phrases, their places, and all labels."""
    found = licenses.license_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    starts = F.transform(base, lambda s: s.start)
    told = lambda spans: F.array_join(F.array_sort(F.array_distinct(
        F.transform(spans, lambda s: s.label))), ",")
    best = F.array_max(F.transform("spans", lambda s: s.similarity))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), told(base).alias("base_labels"),
                        told(F.col("spans")).alias("labels"),
                        F.coalesce(best, F.lit(0.0)).alias("score"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, their first turns taken from their group's first one."""
    scratch = Scratch(spark, "trie")
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"), scratch)
    return prefix_trie.prefix_trie(*prefix_trie.graft(turns, scratch), scratch)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark texts, and the tenth that is drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_packing": op2_packing,
    "op3_substrings": op3_substrings,
    "op4_secret_crf": op4_secret_crf,
    "op5_lattice": op5_lattice,
    "op6_lines": op6_lines,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_mtree": op9_mtree,
    "op10_url_filter": op10_url_filter,
    "op11_licenses": op11_licenses,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_resampling": op13_resampling,
}

#: CRC-32 of the text ``w`` in SQL: the register over its bytes, by a table made on the spot
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM range(256) r(b))"""


def crc_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_transform(range(octet_length(encode({text}))),
    lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1]), 4294967295))"""


SQL: dict[str, str] = {
    "op9_mtree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)
              AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id
           ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_url_filter": """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3)
                       ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hits AS (
  SELECT n, rh || rp AS rule, rv, row_number() OVER (PARTITION BY n
           ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM hits WHERE k = 1) h USING (n)
""",
    "op13_resampling": f"""
WITH {CRC_TABLE},
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS n, doc_id, coalesce(text, '') AS text
  FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
lists AS (
  SELECT kind, n, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
words AS (SELECT kind, n, unnest(words) AS w FROM lists),
named AS (SELECT w, {crc_sql('w')} % 10000 AS bucket
          FROM (SELECT DISTINCT w FROM words), crc_table),
hits AS (SELECT kind, n, bucket FROM words JOIN named USING (w)),
counts AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t
           FROM hits GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts),
weights AS (SELECT n, CAST(sum(gain) AS BIGINT) AS weight
            FROM hits JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY n),
scored AS (
  SELECT n, doc_id, CAST(len(words) AS BIGINT) AS n_features,
    coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM lists LEFT JOIN weights USING (n) WHERE kind = 'd'),
placed AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
    10 * count(*) OVER () // 100 AS m FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= m THEN place END AS rank
FROM scored LEFT JOIN placed USING (n)
""",
    "op12_prefix_trie": f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                            ORDER BY turn NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
given AS (
  SELECT o.c, o.ts, CAST({crc_sql('CAST(o.c AS VARCHAR)')} % 6 AS INTEGER) AS h,
    coalesce(b.ts, []) AS base
  FROM crc_table, own o LEFT JOIN own b ON b.c = o.c - o.c % 100),
conv AS (SELECT c, list_concat(base[1:h], ts[h + 1:]) AS s FROM given),
prefixes AS (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM conv),
nodes AS (
  SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d), '')) AS e,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(first(s)[d].t) END AS cost
  FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS q, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY q, p[1:d-1], d),
tops AS (SELECT n.p, n.d, n.cost, k.n IS NULL AS leaf
         FROM nodes n LEFT JOIN kids k ON k.q = n.p AND k.d = n.d),
sums AS (
  SELECT p[1:a] AS q, a AS d, count(*) FILTER (leaf) AS n_leaves, sum(cost) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM tops) GROUP BY q, a)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs,
  coalesce(k.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  n.e AS ends_sha256
FROM nodes n JOIN sums s ON s.q = n.p AND s.d = n.d
LEFT JOIN kids k ON k.q = n.p AND k.d = n.d
LEFT JOIN nodes u ON u.p = n.p[1:n.d - 1] AND u.d = n.d - 1
""",
}
