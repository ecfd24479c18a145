import pytest


@pytest.fixture(scope="session")
def clash(spark):
    """Adds columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    return lambda df: df.select("*", *[F.lit(1).alias(c) for c in ("body", "item", "doc", "id", "a", "b", "line") if c not in df.columns])
