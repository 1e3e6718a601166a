import pytest


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame, also with extra columns whose names an operator might use."""
    def make(rows, schema, clash=()):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, schema)
        for name in clash:
            df = df.withColumn(name, F.lit("clash"))
        return df
    return make
