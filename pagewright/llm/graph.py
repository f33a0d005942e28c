"""Connected components of an edge list by contraction.

Each partition first reduces its edges to a spanning forest. While many edges are left, every node hooks to its
least neighbour and the edges between the hooks are what the next round works on, which is a fraction of
them; what is left in the end is one numpy union-find in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, releasing


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(root, node)`` for every node of the edges that isn't the least of its component: a forest of stars."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    up = np.arange(len(names))
    while len(x):
        least = np.minimum(up[x], up[y])
        np.minimum.at(up, up[x], least)
        np.minimum.at(up, up[y], least)
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                break
            up = nxt
        open_ = up[x] != up[y]
        x, y = x[open_], y[open_]
    node = np.flatnonzero(up != np.arange(len(names)))
    return names[up[node]], names[node]


#: Edges that are reduced together.
_STEP = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the partition's edges."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        parts.append([c.to_numpy() for c in batch.columns])
        if sum(len(p[0]) for p in parts) > _STEP:
            held, parts = list(forest(*(np.concatenate([h, *(p[k] for p in parts)]) for k, h in enumerate(held)))), []
    root, node = forest(*(np.concatenate([h, *(p[k] for p in parts)]) for k, h in enumerate(held)))
    for lo in range(0, len(root), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(root[lo : lo + 50_000]), pa.array(node[lo : lo + 50_000])], ["a", "b"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least id of each node's tree, for all edges of the one partition."""
    for batch in _forest(batches):
        root, node = (c.to_numpy() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, root])), pa.array(np.concatenate([root, root]))], ["id", "comp"])


def components(edges: DataFrame, few: int = 1_000_000) -> DataFrame:
    """``(id, comp)`` for every end of ``edges (a, b)``; ``comp`` is the least id of the component.

    Up to ``few`` edges are finished in one task; more are contracted first, so neither memory nor the number of
    rounds follows the length of chains. Every round is written to the shared folder. Loops and repeated
    edges change nothing, edges with a null end are ignored, no edges give no rows.
    """
    thin = cut(edges.filter("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(releasing(_forest), "a long, b long"))
    layers: list[DataFrame] = []
    while thin.count() > few:
        both = thin.union(thin.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("up")))
        layers.append(hook)
        ends = lambda c: hook.select(F.col("id").alias(c), F.col("up").alias(f"up_{c}"))  # noqa: B023, E731
        moved = thin.join(ends("a"), "a").join(ends("b"), "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b"))
        thin = cut(moved.filter("a <> b").distinct().mapInArrow(releasing(_forest), "a long, b long"))
    top = cut(thin.coalesce(1).mapInArrow(releasing(_labels), "id long, comp long").distinct())
    for hook in reversed(layers):
        known = top.select(F.col("id").alias("up"), "comp")
        top = cut(hook.join(known, "up", "left").select("id", F.coalesce("comp", "up").alias("comp")))
    return top
