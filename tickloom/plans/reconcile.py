"""Two results of one shape side by side: a full outer join that keeps null keys apart from absence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Keys, every other column of either side with its name as suffix, where a row was found, what differs.

    ``found_in`` is ``both`` or the side that alone has the row; ``differing`` lists the columns of rows
    in both whose values are not the same, null being a value.  Null keys meet each other: each key is compared with
    whether it is null.
    """
    values = [c for c in left.columns if c in right.columns and c not in keys]

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            *[F.col(k).alias(f"_{name}_{k}") for k in keys],
            *[F.col(c).alias(f"{c}_{name}") for c in rows.columns if c not in keys],
            F.lit(True).alias(f"_in_{name}"),
        )

    a, b = names
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_{a}_{k}").eqNullSafe(F.col(f"_{b}_{k}"))
    both = side(left, a).join(side(right, b), same, "full")
    in_a, in_b = F.col(f"_in_{a}").isNotNull(), F.col(f"_in_{b}").isNotNull()
    found = F.when(in_a & in_b, "both").when(in_a, a).otherwise(b)
    unlike = F.filter(
        F.array(*[F.when(in_a & in_b & ~F.col(f"{c}_{a}").eqNullSafe(F.col(f"{c}_{b}")), F.lit(c)) for c in values]),
        lambda c: c.isNotNull(),
    )
    return both.select(
        *[F.when(in_a, F.col(f"_{a}_{k}")).otherwise(F.col(f"_{b}_{k}")).alias(k) for k in keys],
        *[f"{c}_{n}" for n, rows in ((a, left), (b, right)) for c in rows.columns if c not in keys],
        found.alias("found_in"),
        unlike.alias("differing"),
    )
