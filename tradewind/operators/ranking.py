"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Buckets by value: as many as the session's shuffle partitions, within these limits. Parts of one bucket by key, at most.
FEWEST, MOST, SPLITS = 16, 1_024, 64
_KEY, _VALUE, _BORDERS, _BUCKET, _SPLIT, _BEFORE, _INSIDE = "__key", "__value", "__borders", "__bucket", "__split", "__before", "__inside"


def global_rank(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Add ``name`` = 1..n by ``value`` descending, NULLs last, then by the unique ``key``.

    A few quantiles of the values are the borders of buckets: one bucket for each stretch between two borders, and one
    for each border itself, which takes a value that very many rows share. In such a bucket only the key orders the rows,
    so it is cut again at quantiles of the keys. Rows are numbered inside their bucket and moved up by what
    the buckets before hold. The borders are a scalar subquery: no job runs while the plan is built, and both uses of
    the buckets see the same ones. There are as many borders as shuffle partitions, so a bucket is about what a task of any other step
    gets. What is broadcast has one row per bucket, ``2 * MOST * SPLITS`` at most.

    All but the last join sees the two columns only. ``df`` is read four times: a stored table, or rows that ``computed_once`` keeps.
    Keys that aren't numbers are cut by their first seven bytes; many keys with one beginning then share a bucket.
    """
    narrow = df.select(F.col(key).alias(_KEY), F.col(value).alias(_VALUE))
    ranges = min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), FEWEST), MOST)
    number = _KEY
    if not isinstance(df.schema[key].dataType, NumericType):
        number = f"CAST(conv(hex(substr(CAST({_KEY} AS STRING), 1, 7)), 16, 10) AS BIGINT)"
    shares, splits = (", ".join(f"{i / n}D" for i in range(1, n)) for n in (ranges, min(ranges, SPLITS)))
    borders = narrow.selectExpr(
        f"struct(array_distinct(percentile_approx({_VALUE}, array({shares}))) AS v,"
        f" array_distinct(percentile_approx({number}, array({splits}))) AS k) AS borders"
    ).scalar()
    at_border = f"coalesce(array_contains({_BORDERS}.v, {_VALUE}), false)"
    placed = narrow.withColumn(_BORDERS, borders).selectExpr(
        _KEY,
        _VALUE,
        f"IF({_VALUE} IS NULL, {2 * ranges + 1}, 2 * size(filter({_BORDERS}.v, b -> b >= {_VALUE})) - IF({at_border}, 1, 0)) AS {_BUCKET}",
        f"IF({at_border} OR {_VALUE} IS NULL, coalesce(size(filter({_BORDERS}.k, b -> b < {number})), 0), 0) AS {_SPLIT}",
    )
    sizes = placed.groupBy(_BUCKET, _SPLIT).agg(F.expr("COUNT(*) AS n"))
    offsets = sizes.selectExpr(
        f"{_BUCKET} AS of_bucket",
        f"{_SPLIT} AS of_split",
        f"coalesce(SUM(n) OVER (ORDER BY {_BUCKET}, {_SPLIT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        f" AS {_BEFORE}",
    )
    inside = f"row_number() OVER (PARTITION BY {_BUCKET}, {_SPLIT} ORDER BY {_VALUE} DESC, {_KEY}) AS {_INSIDE}"
    same = (F.col(_BUCKET) == F.col("of_bucket")) & (F.col(_SPLIT) == F.col("of_split"))
    ranks = placed.selectExpr("*", inside).join(F.broadcast(offsets), same).selectExpr(_KEY, f"{_BEFORE} + {_INSIDE} AS {name}")
    return df.join(ranks, F.col(key).eqNullSafe(F.col(_KEY))).drop(_KEY)


def small_rank(order_by: str) -> str:
    """Row number over a result whose size does not grow with the data (months, categories)."""
    return f"row_number() OVER (ORDER BY {order_by})"
