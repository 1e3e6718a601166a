"""quarry: a Spark-native retrieval engine.

Text sources become sentence-aligned, token-bounded chunks; chunks become vectors in an
append-only Parquet corpus with dense ids; batches of queries are answered with exact or
approximate nearest-neighbour search, and prompt / request / answer tables are built from the
retrieved context. Everything is DataFrame work planned by Catalyst.
"""

from quarry.session import checkpoint_dir, discard, get_spark, store

__all__ = ["checkpoint_dir", "discard", "get_spark", "store"]
