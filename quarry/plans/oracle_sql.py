"""DuckDB SQL that recomputes each registered query from the raw tables (the correctness
oracle). Pieces are generated from the same fixed values the Spark code uses."""

from __future__ import annotations

from quarry.functions.text import DEFAULT_CHUNK_TOKENS, SPECIAL_TOKENS, TOKEN_PATTERN, WORD_PATTERN
from quarry.operators import generation as gen

DIM = 64
LIMIT = DEFAULT_CHUNK_TOKENS


def lit(s: str) -> str:
    """SQL string literal; newlines become chr(10)."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def sentences_cte(name: str, src: str, ids: list[str], text: str = "text") -> str:
    idl = ", ".join(ids)
    return f"""{name} AS (
  SELECT {idl}, CAST(i - 1 AS INTEGER) AS sent_no, arr[i] AS sentence,
    CAST(len(regexp_extract_all(arr[i], '{TOKEN_PATTERN}')) + {SPECIAL_TOKENS} AS INTEGER) AS n_tokens
  FROM (SELECT {idl}, arr, generate_subscripts(arr, 1) AS i FROM (
    SELECT {idl}, list_filter(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'),
                                          chr(1)), lambda x: x <> '') AS arr
    FROM {src})))"""


def pack_cte(name: str, sents: str, ids: list[str], limit: int = LIMIT) -> str:
    idl = ", ".join(ids)
    on = " AND ".join(f"s.{c} = p.{c}" for c in ids)
    sel = ", ".join(f"s.{c}" for c in ids)
    return f"""{name} AS (
  SELECT {idl}, sent_no, n_tokens, n_tokens AS cur, 0 AS chunk_no FROM {sents} WHERE sent_no = 0
  UNION ALL
  SELECT {sel}, s.sent_no, s.n_tokens,
    CASE WHEN p.cur + s.n_tokens <= {limit} THEN p.cur + s.n_tokens ELSE s.n_tokens END,
    CASE WHEN p.cur + s.n_tokens <= {limit} THEN p.chunk_no ELSE p.chunk_no + 1 END
  FROM {name} p JOIN {sents} s ON {on} AND s.sent_no = p.sent_no + 1)"""


def chunks_cte(name: str, sents: str, pack: str, ids: list[str]) -> str:
    idl = ", ".join(ids)
    return f"""{name} AS (
  SELECT {idl}, CAST(p.chunk_no AS INTEGER) AS chunk_no,
    string_agg(s.sentence, ' ' ORDER BY s.sent_no) AS chunk,
    CAST(sum(s.n_tokens) AS INTEGER) AS n_tokens
  FROM {pack} p JOIN {sents} s USING ({idl}, sent_no)
  GROUP BY {idl}, p.chunk_no)"""


def chunk_pipeline(src: str, ids: list[str], text: str = "text", prefix: str = "",
                   limit: int = LIMIT) -> str:
    """CTEs ``{prefix}sents``, ``{prefix}pack``, ``{prefix}chunks`` (needs WITH RECURSIVE)."""
    s, p, c = f"{prefix}sents", f"{prefix}pack", f"{prefix}chunks"
    return ",\n".join([sentences_cte(s, src, ids, text), pack_cte(p, s, ids, limit),
                       chunks_cte(c, s, p, ids)])


def embed_cte(name: str, src: str, ids: list[str], text: str, dim: int = DIM) -> str:
    """CTE ``name(ids..., embedding FLOAT[])``: hashing embedder."""
    idl = ", ".join(ids)
    return f"""{name}_bk AS (
  SELECT {idl}, list_transform(regexp_extract_all(lower({text}), '{WORD_PATTERN}'),
    lambda w: CAST((('0x' || substr(md5(w), 1, 8))::BIGINT) % {dim} AS INTEGER)) AS bk
  FROM {src}),
{name}_cnt AS (
  SELECT {idl}, list_transform(range({dim}),
    lambda b: CAST(len(list_filter(bk, lambda x: x = b)) AS DOUBLE)) AS cnt FROM {name}_bk),
{name} AS (
  SELECT {idl}, list_transform(cnt,
    lambda c: CAST(CASE WHEN nrm = 0 THEN 0 ELSE c / nrm END AS FLOAT)) AS embedding
  FROM (SELECT *, sqrt(list_sum(list_transform(cnt, lambda c: c * c))) AS nrm FROM {name}_cnt))"""


def doc_corpus_ctes() -> str:
    """``corpus(idx, doc_name, chunk_no, chunk, embedding)`` built from ``documents``."""
    return ",\n".join([
        chunk_pipeline("documents", ["doc_id"]),
        embed_cte("chunk_emb", "chunks", ["doc_id", "chunk_no"], "chunk"),
        """corpus AS (
  SELECT row_number() OVER (ORDER BY c.doc_id, c.chunk_no) AS idx, 'doc_' || c.doc_id AS doc_name,
    c.chunk_no, c.chunk, e.embedding
  FROM chunks c JOIN chunk_emb e USING (doc_id, chunk_no))"""])


def prompt_expr(query: str, context: str | None) -> str:
    """SQL for ``generation.build_prompt``."""
    head = (f"{lit(gen.PROMPT_INTRO + chr(10) + chr(10) + gen.SECTION_PREFS + chr(10) + gen.PREFERENCES + chr(10) + chr(10) + gen.SECTION_QUERY + chr(10))}"
            f" || {query} || chr(10) || chr(10)")
    tail = lit(gen.SECTION_ANSWER + "\n")
    if context is None:
        return f"({head} || {tail})"
    ctx = f"array_to_string(list_transform({context}, lambda s: '- ' || s), chr(10))"
    with_ctx = f"{head} || {lit(gen.SECTION_CONTEXT + chr(10))} || {ctx} || chr(10) || chr(10) || {tail}"
    return f"(CASE WHEN {context} IS NULL THEN {head} || {tail} ELSE {with_ctx} END)"
