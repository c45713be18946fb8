"""Search blocks: groups of nodes that may be linked, packed or cut into tasks of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of one block: of many small groups together, and of one part of a large group.
BIN, BLOCK = 1 << 17, 1 << 20


def search_blocks(groups: DataFrame) -> DataFrame:
    """(node, part, blocks) for (node, root, n): the blocks that a node takes part in.

    Only nodes of one group (``root``) may be linked; ``n`` is a node's weight. Groups up to
    ``BLOCK`` are packed into blocks of about ``BIN``. A larger group is cut into parts by a hash of
    the node, and every two parts form a block, as does each part with itself. Groups of one node
    are left out.
    """
    weights = groups.groupBy("root").agg(F.sum("n").alias("weight"), F.count("*").alias("nodes"))
    weights = weights.where("nodes > 1")
    total = weights.agg(F.sum(F.when(F.col("weight") <= BLOCK, F.col("weight")))).first()[0] or 0
    bins = max(1, -(-total // BIN))
    parts = F.ceil(F.col("weight") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.concat_ws(
            ":", F.col("root").cast("string"), F.least("part", i), F.greatest("part", i)
        ),
    )
    small = F.array(F.pmod(F.xxhash64("root"), F.lit(bins)).cast("string"))
    return (
        groups.join(weights.select("root", parts.alias("parts")), "root")
        .withColumn("part", F.when(F.col("parts") > 1, part).otherwise(F.lit(0)))
        .select("node", "part", F.when(F.col("parts") > 1, pairs).otherwise(small).alias("blocks"))
    )


class Forest:
    """Components of a block's nodes; ``of`` is always the root, so arrays can be looked up at once."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> bool:
        """Whether this joined two components."""
        a, b = int(self.of[a]), int(self.of[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.of[moved] = a
        self.members[a].extend(moved)
        return True
