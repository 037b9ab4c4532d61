"""Images and hierarchies from tables. Pixels are rows (image_id, pixel, row, col, value), dense and row-major."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.operators.edits import export_compact, import_compact  # noqa: F401
from silvagrid.plans.tree import Tree, from_native


def rasterised(df: DataFrame, row: Column, col: Column, value: Column, rows: int, cols: int, image_id: Column | None = None) -> DataFrame:
    """One image of rows x cols for each image_id: an aggregate of the rows that fall in a cell, 0 where none do.
    The grid is made by an explode beside the image ids, so images are made dense without a cross join."""
    image = F.lit("0") if image_id is None else image_id.cast("string")
    cells = df.groupBy(image.alias("image_id"), row.cast("int").alias("row"), col.cast("int").alias("col")).agg(value.alias("value"))
    ids = df.select(image.alias("image_id")).distinct()
    # a cell's place comes out of the generator: were row and col computed from pixel here, the optimiser would
    # carry these expressions through the join's constraints without end
    cell = F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda p: F.struct(p.cast("long").alias("pixel"), F.floor(p / cols).cast("int").alias("row"), (p % cols).cast("int").alias("col")))
    grid = ids.select("image_id", F.explode(cell).alias("cell")).select("image_id", "cell.pixel", "cell.row", "cell.col")
    return grid.join(cells, ["image_id", "row", "col"], "left").select("image_id", "pixel", "row", "col", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def from_long_table(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """(image_id, row, col, value) of images that are dense already."""
    return df.select(F.col("image_id").cast("string").alias("image_id"), (F.col("row") * cols + F.col("col")).cast("long").alias("pixel"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value")


def from_gray_files(spark: SparkSession, path: str) -> DataFrame:
    """Binary grey-map files (P5, 8 bits), one image a file; image_id is the path."""
    import numpy as np
    import pandas as pd

    def run(frames):
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                fields, at = [], 0
                while len(fields) < 4:
                    end = at
                    while data[end : end + 1] not in (b" ", b"\n", b"\t", b"\r"):
                        end += 1
                    if data[at : at + 1] == b"#":
                        end = data.index(b"\n", at)
                    elif end > at:
                        fields.append(bytes(data[at:end]))
                    at = end + 1
                if fields[0] != b"P5" or int(fields[3]) > 255:
                    raise ValueError(f"{name} is no 8-bit binary grey map")
                c, r = int(fields[1]), int(fields[2])
                v = np.frombuffer(data, np.uint8, r * c, at)
                p = np.arange(r * c)
                yield pd.DataFrame({"image_id": name, "pixel": p, "row": p // c, "col": p % c, "value": v.astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "image_id string, pixel long, row int, col int, value long")


def lineitem_raster(spark: SparkSession, sf_dir: str, size: int = 16, levels: int = 8, by: Column | None = None) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rasterised(li, F.col("l_partkey") % size, F.col("l_suppkey") % size, F.floor(F.sum("l_quantity")).cast("long") % levels, size, size, by)


def customer_hierarchy(spark: SparkSession, sf_dir: str) -> Tree:
    """World, regions, nations and customers with orders; the orders are the pixels. No kernel runs."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select(F.col("o_orderkey").cast("long").alias("pixel"), (F.col("o_custkey") + 1000).cast("long").alias("node_id"))
    active = orders.select((F.col("node_id") - 1000).alias("c_custkey")).distinct()
    customer = read("customer").join(active, "c_custkey")
    nation = read("nation").join(customer.select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey")
    region = read("region").join(nation.select(F.col("n_regionkey").alias("r_regionkey")).distinct(), "r_regionkey")
    node = lambda df, i, p, a: df.select(F.lit("world").alias("tree_id"), i.cast("long").alias("node_id"), p.cast("long").alias("parent_id"), a.cast("double").alias("altitude"))
    nodes = node(spark.range(1), F.lit(0), F.lit(0), F.lit(0))
    nodes = nodes.union(node(region, F.col("r_regionkey") + 1, F.lit(0), F.col("r_regionkey") + 10))
    nodes = nodes.union(node(nation, F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, F.col("n_nationkey") + 100))
    nodes = nodes.union(node(customer, F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, F.col("c_custkey") % 50 + 1000))
    return from_native(nodes, orders.select(F.lit("world").alias("tree_id"), "pixel", "node_id"), "increasing")
