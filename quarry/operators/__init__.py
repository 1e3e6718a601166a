"""DataFrame -> DataFrame operators built from Spark's relational operators."""
