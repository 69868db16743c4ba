"""Rows of equal keys compared in blocks of bounded size, so that no key is one task and no pair is a row.

``deal`` cuts the rows of a key into parts of about ``part`` rows; a block holds two parts (or one part
twice), and every pair of the key's rows meets in exactly one block. Blocks are put together into groups of
about ``group`` rows, which a grouped Arrow function gets whole; ``segments`` takes them apart again. A key
of n rows is copied n / part times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Columns that ``deal`` adds.
DEALT = ("grp", "block", "i", "j", "mine")


def deal(rows: DataFrame, key: list[str], spread: str, part: int, group: int) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with DEALT columns, ready for ``groupBy("grp")``, without keys of one row; and the tables to
    discard after use. Rows of a key are spread over its parts by a hash of the column ``spread``."""
    sizes = materialize(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / part).cast("int")), "sizes")
    total = sizes.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    groups = max(1, -(-int(total) // group))
    # a written table on the unique side: Spark can split the hot keys of the other
    out = rows.join(sizes.drop("n").hint("merge"), key).withColumn("mine", F.expr(f"cast(pmod(hash({spread}), parts) as int)"))
    out = out.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    out = out.withColumn("block", F.xxhash64(*key, "i", "j"))
    return out.withColumn("grp", F.pmod("block", F.lit(groups)).cast("int")).drop("other", "parts"), [sizes]


def segments(block: np.ndarray, *also: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each block; blocks are told apart by ``also`` too, where two hashes collide."""
    order = np.lexsort((*also, block))
    new = np.zeros(len(order), bool)
    for c in (block, *also):
        new[1:] |= c[order][1:] != c[order][:-1]
    yield from np.split(order, np.flatnonzero(new))
