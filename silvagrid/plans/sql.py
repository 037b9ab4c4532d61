"""The constructions as table functions for SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from silvagrid.kernels import trees as K

_NODES = "node_id long, parent_id long, altitude double, area long"


def _function(build):
    class Nodes:
        """Takes (row, col, value) of one image, partitioned by image; gives its nodes."""

        def __init__(self):
            self.cells: list[tuple[int, int, int]] = []

        def eval(self, row):
            self.cells.append((row["row"], row["col"], row["value"]))

        def terminate(self):
            if not self.cells:
                return
            a = np.array(sorted(self.cells))
            h = build(a[:, 2].reshape(int(a[:, 0].max()) + 1, -1))
            for i, s in enumerate(K.supports(h)):
                yield i, int(h.parent[i]), float(h.altitude[i]), len(s)

    return udtf(Nodes, returnType=_NODES)


def register(spark: SparkSession) -> None:
    """max_tree, min_tree, tree_of_shapes and residual_tree, called as f(TABLE(t) PARTITION BY image_id)."""
    for name, build in (("max_tree", lambda im: K.component_tree(im)), ("min_tree", lambda im: K.component_tree(im, None, False)), ("tree_of_shapes", lambda im: K.tree_of_shapes(im)), ("residual_tree", lambda im: K.residual_tree(im)[0])):
        spark.udtf.register(name, _function(build))
