"""One row per key, with the survivor settled by an order instead of by chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

_RANK = "__survivor"


def first_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (), ignore_prefix: str = "bronze_"
) -> DataFrame:
    """Keep the first row of each key by ``order_by`` (SQL order terms, such as "seq DESC").

    Rows that the order leaves equal are settled by a digest of the row and its NULLs, so the survivor never
    depends on the partitioning; columns with ``ignore_prefix`` (metadata of the run) stay out of it.
    Spark turns the filter on the row number into a per-task limit before the shuffle: a key that
    holds a large share of all rows leaves each map task as one row.
    """
    told = [f"`{c}`" for c in df.columns if not c.startswith(ignore_prefix)]
    order = ", ".join([*order_by, f"xxhash64({', '.join([*told, *[f'{c} IS NULL' for c in told]])})"])
    place = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})"
    return df.selectExpr("*", f"{place} AS {_RANK}").filter(f"{_RANK} = 1").drop(_RANK)
