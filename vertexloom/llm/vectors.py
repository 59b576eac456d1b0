"""What the vector operators share: which vectors take part, and buckets dealt to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 20_000  # rows of buckets handled in one task call, about


def usable(vector: Column) -> Column:
    """False for null, empty and zero vectors and those with a null or non-finite component."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    nonzero = F.exists(vector, lambda x: x != 0)
    return F.coalesce((F.size(vector) > 0) & finite & nonzero, F.lit(False))


def group_count(n_rows: int, rows: int = GROUP_ROWS) -> int:
    return max(1, -(-n_rows // rows))


def matrix(column):
    """Rows of a pandas column of arrays as a float64 matrix."""
    import numpy as np

    return np.stack(column.to_numpy()).astype(np.float64)


def of_rows(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
