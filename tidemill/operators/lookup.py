"""Join many rows to a lookup table when few keys may own most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, spread_by: str,
                how: str = "left", heavy_rows: int | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup`` on ``key`` where few keys may own most of the rows.

    Both sides get an exchange of their own, even where the lookup is already
    partitioned by the key (by an aggregate, say): so the adaptive planner can
    split a partition that one key fills into as many tasks as it has advisory
    sizes. With ``heavy_rows`` the keys are counted first, with partial sums,
    and one with more rows than that is spread over a task for each so many:
    only such keys' lookup rows are repeated. ``spread_by`` varies within a key.
    """
    if how not in ("left", "inner"):
        raise ValueError("rows must be the preserved side: left or inner")
    if heavy_rows is None:
        # A second key that is one for all rows, though the planner doesn't know it.
        one = F.explode(F.array(F.lit(0)))
        salted = rows.withColumn(SALT, F.pmod(F.xxhash64(spread_by), F.lit(1)).cast("int"))
        return salted.join(lookup.withColumn(SALT, one), [key, SALT], how).drop(SALT)
    salts = F.ceil(F.col("count") / heavy_rows).cast("int")
    heavy = rows.groupBy(key).count().filter(F.col("count") > heavy_rows).select(key, salts.alias("_salts"))
    chosen = F.pmod(F.xxhash64(spread_by), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = rows.join(heavy, key, "left").withColumn(SALT, chosen).drop("_salts")
    last = F.coalesce("_salts", F.lit(1)) - 1
    copies = (lookup.join(heavy, key, "left")
              .withColumn(SALT, F.explode(F.sequence(F.lit(0), last))).drop("_salts"))
    return salted.join(copies, [key, SALT], how).drop(SALT)
