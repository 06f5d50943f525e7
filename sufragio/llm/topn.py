"""The N highest-scoring rows of every group with a fixed tie order.

One scan: each partition keeps its own N best rows of every group in an Arrow map, sorting what it
holds only when that has doubled, so nothing is shuffled and a partition holds at most twice its
own survivors. The N-th of them is a lower bound of the group's N-th best score anywhere. The
highest such bound per group is joined back (by broadcast if its measured size allows), rows below
it are dropped before anything is shuffled, and the few survivors are ranked. At most N narrow
rows per group and partition are ever written, however many rows a group holds, and no task holds
a whole group.

Defined cases: rows with a null group column, or a null or NaN score, are left out; ties of the
score are settled by `ties` in order, nulls last; rows equal in all of these keep their number but
their order among themselves is open; N below 1 gives no rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sufragio.session import materialize, measured

#: Rows that a partition holds at least before it sorts them.
HELD = 100_000


def _first_of_each(held: pa.Table, keys: list[str], order: list[tuple[str, str]], n: int) -> tuple[pa.Table, np.ndarray]:
    """The first n rows of each group by order, and their places from 1."""
    held = held.take(pc.sort_indices(held, sort_keys=order, null_placement="at_end"))
    group = np.zeros(held.num_rows, dtype=np.int64)
    for k in keys:
        codes = held[k].combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        group = np.unique(group * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    by = np.argsort(group, kind="stable")
    new = np.r_[True, np.diff(group[by]) != 0] if len(by) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else by
    place = np.empty(len(by), dtype=np.int32)
    place[by] = np.arange(len(by)) - start + 1
    return held.filter(pa.array(place <= n)), place[place <= n]


def local_best(narrow: DataFrame, keys: list[str], order: list[tuple[str, str]], n: int) -> DataFrame:
    """narrow's N best rows of every group and partition, with __rank; no exchange."""
    schema = StructType([*narrow.schema.fields, StructField("__rank", IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, HELD
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= limit:
                held = _first_of_each(pa.Table.from_batches(held), keys, order, n)[0].to_batches()
                rows = sum(x.num_rows for x in held)
                limit = max(HELD, 2 * rows)
        if rows:
            best, place = _first_of_each(pa.Table.from_batches(held), keys, order, n)
            yield from best.append_column("__rank", pa.array(place, pa.int32())).to_batches()

    return narrow.mapInArrow(run, schema)


def top_n(df: DataFrame, groups: dict[str, Column], score: str, ties: Sequence[tuple[str, bool]], n: int, keep: Sequence[str], position: str = "posicao") -> DataFrame:
    """groups: output name and expression of each group column; ties: names out of `keep`, each
    with True for ascending; keep: columns returned beside groups and position."""
    keys = [f"__g{i}" for i in range(len(groups))]
    narrow = df.select(
        *[e.alias(k) for k, e in zip(keys, groups.values())], F.col(f"`{score}`").alias("__score"), *[F.col(f"`{c}`") for c in dict.fromkeys(keep)],
        *[F.col(f"`{t}`").isNull().alias(f"__null{i}") for i, (t, _) in enumerate(ties)],
    ).dropna(subset=[*keys, "__score"])
    if dict(narrow.dtypes)["__score"] in ("float", "double"):
        narrow = narrow.filter(~F.isnan("__score"))
    order = [("__score", "descending")]
    for i, (t, rising) in enumerate(ties):
        order += [(f"__null{i}", "ascending"), (t, "ascending" if rising else "descending")]
    local = materialize(local_best(narrow, keys, order, max(n, 0)), "local-best")
    # any N rows of one partition prove that the group's N-th score is at least their lowest
    bound, _ = measured(materialize(local.filter(F.col("__rank") == n).groupBy(*keys).agg(F.max("__score").alias("__bound")), "bounds"))
    survivors = local.join(bound, keys, "left").filter(F.col("__bound").isNull() | (F.col("__score") >= F.col("__bound")))
    sort = [F.col(f"`{c}`").asc() if way == "ascending" else F.col(f"`{c}`").desc() for c, way in order]
    ranked = survivors.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))).filter(F.col(position) <= n)
    return ranked.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], position, *[F.col(f"`{c}`") for c in dict.fromkeys(keep)])
