"""Graph reachability to a fixpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelog.plans.shared import shared_dir


def reachable(edges: DataFrame, a: str, b: str, roots: DataFrame) -> DataFrame:
    """(node): all nodes that a path from a root reaches, roots included. A round a step; each is written to the shared folder."""
    spark = edges.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = f"{shared_dir(spark)}/closure-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    node = roots.columns[0]
    seen = frontier = kept(roots.distinct())
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col(node) == F.col(a)).select(F.col(b).cast(dict(roots.dtypes)[node]).alias(node)).distinct()
        frontier = kept(step.join(seen, node, "left_anti"))
        seen = seen.unionByName(frontier)
    return seen
