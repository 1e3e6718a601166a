"""Secret scan over a text table: find key-like strings with native regexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Key formats looked for. Each entry is (kind, candidate, anchored format):
# the candidate pattern takes a whole alphanumeric run that starts after a non-alphanumeric
# character (or the text start) and consumes only that leading character, so secrets one
# separator apart are all found; the anchored format then decides.
KEY_FORMAT = r"^sk-[A-Za-z0-9]{20}T3BlbkFJ[A-Za-z0-9]{20}$"
SECRET_PATTERNS = (
    ("api_key", r"(?:^|[^A-Za-z0-9])(sk-[A-Za-z0-9]*)", KEY_FORMAT),
    ("hex40", r"(?:^|[^A-Za-z0-9])([0-9a-f]{40}[A-Za-z0-9]*)", r"^[0-9a-f]{40}$"),
)


def _matches(fmt: str):
    return lambda h: h.rlike(fmt)


def is_key_format(col) -> F.Column:
    """Anchored key-format predicate for one value."""
    col = F.col(col) if isinstance(col, str) else col
    return col.rlike(KEY_FORMAT)


def secret_scan(df: DataFrame, id_cols=("doc_id",), text_col: str = "text",
                patterns=SECRET_PATTERNS) -> DataFrame:
    """(ids..., kind, hit_no, secret): one row per hit, hits numbered in text order."""
    ids = [F.col(c) for c in id_cols]
    found = F.array(*[F.struct(F.lit(kind).alias("kind"),
                               F.filter(F.regexp_extract_all(F.col(text_col), F.lit(cand), 1),
                                        _matches(fmt)).alias("hits"))
                      for kind, cand, fmt in patterns])
    per_kind = df.select(*ids, F.explode(found).alias("k"))
    return (per_kind.select(*ids, F.col("k.kind").alias("kind"),
                            F.posexplode_outer("k.hits"))
                    .where(F.col("pos").isNotNull())
                    .select(*ids, "kind", F.col("pos").cast("int").alias("hit_no"),
                            F.col("col").alias("secret")))
