"""Prompt, request and answer tables for retrieval-augmented generation.

The model call itself happens outside Spark (a batch-inference service reads the payload table
and returns a reply table). Spark builds prompts, payloads, parses replies and assembles
answers, all with native column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.models import read_models

# Serving defaults.
DEFAULT_K = 5
HOSTED_K = 10
LOCAL_K = 3
TEMPERATURE = 0.7
REPEAT_PENALTY = 1.2
HOSTED_MARKER = "openai"

# Prompt template. Sections: preferences, request, optional context, answer. The defaults are
# neutral; callers pass their own preferences.
PREFERENCES = "Be brief."
PROMPT_INTRO = "Answer the request below."
SECTION_PREFS = "## Notes"
SECTION_QUERY = "## Request"
SECTION_CONTEXT = "## Context"
SECTION_ANSWER = "## Answer"


def context_list(ctx) -> Column:
    """Each chunk prefixed with ``- ``, one per line."""
    ctx = F.col(ctx) if isinstance(ctx, str) else ctx
    return F.array_join(F.transform(ctx, lambda s: F.concat(F.lit("- "), s)), "\n")


def build_prompt(query, context=None, preferences: str = PREFERENCES) -> Column:
    """Prompt text; the context section appears only when ``context`` is not NULL. Ends with
    a newline."""
    query = F.col(query) if isinstance(query, str) else query
    head = F.concat(F.lit(f"{PROMPT_INTRO}\n\n{SECTION_PREFS}\n{preferences}\n\n"
                          f"{SECTION_QUERY}\n"), query, F.lit("\n\n"))
    tail = F.lit(f"{SECTION_ANSWER}\n")
    if context is None:
        return F.concat(head, tail)
    context = F.col(context) if isinstance(context, str) else context
    with_ctx = F.concat(head, F.lit(f"{SECTION_CONTEXT}\n"), context_list(context),
                        F.lit("\n\n"), tail)
    return F.when(context.isNull(), F.concat(head, tail)).otherwise(with_ctx)


def family_of(model) -> Column:
    model = F.col(model) if isinstance(model, str) else model
    return F.when(F.instr(model, HOSTED_MARKER) > 0, F.lit("hosted")).otherwise(F.lit("local"))


def k_of(family) -> Column:
    family = F.col(family) if isinstance(family, str) else family
    return F.when(family == "hosted", F.lit(HOSTED_K)).otherwise(F.lit(LOCAL_K))


def route_models(requests: DataFrame, models: DataFrame | None = None,
                 key_col: str = "conv_id") -> DataFrame:
    """Adds model, family and k. Each request picks model ``pmod(key, n_models)`` of the model
    table, which is a handful of rows (a proven bound), so it is broadcast."""
    spark = requests.sparkSession
    models = models if models is not None else read_models(spark)
    n_models = models.count()  # a handful of tags
    picked = requests.withColumn("model_no", F.pmod(F.col(key_col), F.lit(n_models)).cast("int"))
    return (picked.join(F.broadcast(models), "model_no")
                  .withColumn("family", family_of("model"))
                  .withColumn("k", k_of("family"))
                  .drop("model_no"))


def api_model_name(model) -> Column:
    """Hosted tags carry a provider prefix (``openai:``) that the request body omits."""
    model = F.col(model) if isinstance(model, str) else model
    return F.regexp_replace(model, r"^openai:", "")


def payload(model, family, prompt, temperature: float = TEMPERATURE) -> Column:
    """JSON request body: hosted chat form or local generate form."""
    model, family, prompt = [F.col(c) if isinstance(c, str) else c
                             for c in (model, family, prompt)]
    hosted = F.to_json(F.struct(
        api_model_name(model).alias("model"),
        F.lit(temperature).cast("double").alias("temperature"),
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")))
    local = F.to_json(F.struct(
        model.alias("model"), F.lit(False).alias("stream"), prompt.alias("prompt"),
        F.struct(F.lit(temperature).cast("double").alias("temperature"),
                 F.lit(REPEAT_PENALTY).cast("double").alias("repeat_penalty")).alias("options")))
    return F.when(family == "hosted", hosted).otherwise(local)


_HOSTED_REPLY = "struct<choices: array<struct<message: struct<content: string>>>>"
_LOCAL_REPLY = "struct<response: string>"


def reply_text(family, body) -> Column:
    """Reply text: ``choices[0].message.content`` (hosted) or ``response`` (local); NULL for a
    malformed body."""
    family = F.col(family) if isinstance(family, str) else family
    body = F.col(body) if isinstance(body, str) else body
    hosted = F.from_json(body, _HOSTED_REPLY)["choices"][0]["message"]["content"]
    local = F.from_json(body, _LOCAL_REPLY)["response"]
    return F.when(family == "hosted", hosted).otherwise(local)


def parse_responses(responses: DataFrame, id_cols=("query_id",), family_col: str = "family",
                    status_col: str = "status", body_col: str = "body") -> DataFrame:
    """(ids..., status, result, error): only status 200 with a well-formed body gives a
    result; every other row keeps its id with an error text. Use ``ok_rows`` /
    ``rejected_rows`` to split."""
    text = reply_text(family_col, body_col)
    status = F.col(status_col)
    return responses.select(
        *id_cols, status.alias("status"),
        F.when(status == 200, text).alias("result"),
        F.when(status != 200, F.concat(F.lit("request failed with status "),
                                       status.cast("string")))
         .when(text.isNull(), F.lit("malformed reply"))
         .alias("error"))


def ok_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull())


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull())


def answers(parsed: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, result, idx_list, doc_names, chunks, served): one row per answered query;
    ``served`` is the JSON reply ``{result, doc_names}`` with distinct names."""
    ok = ok_rows(parsed).select("query_id", "result")
    j = ok.join(results, "query_id", "left")
    return j.select("query_id", "result", "idx_list", "doc_names", "chunks",
                    F.to_json(F.struct(F.col("result").alias("result"),
                                       F.array_distinct("doc_names").alias("doc_names")))
                     .alias("served"))
