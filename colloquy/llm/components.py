"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import written


# Links that one task contracts (about 200 bytes each while it does).
LINKS_A_TASK = 250_000


def _contracted(links: DataFrame, links_a_task: int) -> tuple[DataFrame, int]:
    """(v, u): every part of the links replaced by stars around its least vertices."""
    parts = max(1, -(-links.count() // links_a_task))
    kinds = links.schema

    def run(batches):
        import pyarrow as pa

        parent: dict = {}

        def root(x):
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        vertices = list(parent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(vertices, batch_type), pa.array([root(v) for v in vertices], batch_type)], kinds.names
        )

    batch_type = to_arrow_type(kinds[0].dataType)
    # Narrow rows, dealt so that a task gets no more than its bound.
    dealt = links.coalesce(1) if parts == 1 else links.repartition(parts)
    return dealt.mapInArrow(run, kinds), parts


def components(
    links: DataFrame, a: str, b: str, *, links_a_task: int = LINKS_A_TASK, max_rounds: int = 60
) -> DataFrame:
    """(vertex, label): each vertex of a link with the smallest vertex it can reach.

    Parts of the links of bounded size are contracted to stars in a task each. If
    there is one part that is the answer; else, in rounds, a vertex takes the
    least label among its neighbours and then that of the vertex it is labelled
    with, so paths shorten twofold or better. Labels are aggregated before they
    are shuffled, so a vertex of many links is no burden to one task. Each round
    is a written table.
    """
    links = links.select(F.col(a).alias("v"), F.col(b).alias("u"))
    stars, parts = _contracted(links, links_a_task)
    if parts == 1:
        return written(stars.select(F.col("v").alias("vertex"), F.col("u").alias("label")), "labels")
    stars = written(stars, "stars")
    edges = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
    edges = written(edges, "links")
    labels = edges.groupBy(F.col("v").alias("vertex")).agg(F.min("u").alias("label"))
    labels = written(labels.select("vertex", F.least("vertex", "label").alias("label")), "labels")
    for _ in range(max_rounds):
        near = (
            edges.join(labels.select(F.col("vertex").alias("u"), "label"), "u")
            .groupBy(F.col("v").alias("vertex"))
            .agg(F.min("label").alias("near"))
        )
        least = labels.join(near, "vertex").select(
            "vertex", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        ends = labels.select(F.col("vertex").alias("label"), F.col("label").alias("end"))
        labels = written(
            least.join(ends, "label").select("vertex", "old", F.least("label", "end").alias("label")), "labels"
        )
        if labels.where("label <> old").isEmpty():
            return labels.select("vertex", "label")
        labels = labels.select("vertex", "label")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
