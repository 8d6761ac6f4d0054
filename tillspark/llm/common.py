"""Small helpers the operators of this folder share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def fold_of(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; rows without an id are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each linked node: columns node, component.

    Every round sends each node's smallest neighbour label to the node and
    then jumps along the labels, so long chains shorten geometrically. A
    round is written to the shared folder; nothing is collected but the
    number of changed labels.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.union(both.select("other", "node")).filter(F.col("node") != F.col("other"))
    edges = materialize(both.distinct(), "links")
    labels = materialize(
        edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels"
    )
    while True:
        # Smallest label among a node and its neighbours. Labels are nodes
        # themselves, and each one hears what its followers heard.
        heard = (
            edges.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node").agg(F.min("component").alias("heard"))
        )
        met = labels.join(heard, "node").select(
            "node", "component", F.least("component", "heard").alias("low")
        )
        told = met.groupBy(F.col("component").alias("node")).agg(F.min("low").alias("told"))
        step = met.join(told, "node", "left").select(
            "node", F.col("component").alias("before"),
            F.least("low", F.coalesce("told", "low")).alias("component"),
        )
        after = step.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        step = materialize(
            step.join(after, "component", "left").select(
                "node", "before", F.least("component", F.coalesce("jump", "component")).alias("component")
            ),
            "labels",
        )
        labels = step.select("node", "component")
        if step.filter("before <> component").isEmpty():
            return labels


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))  # a copy, changed in place from here on
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sum_arrays(parts: DataFrame, keys: list[str], value: str, spread: int = 64) -> DataFrame:
    """Element-wise sums of equally long arrays per key, in two levels.

    The first level adds within (key, slice), the second over at most
    `spread` slices, so no task sees every partition's array of a key.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*keys).schema)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].iloc[:1].copy()
        out[value] = [np.sum(np.stack(pdf[value].to_numpy()), axis=0)]
        return out

    sliced = parts.select(*keys, value, (F.spark_partition_id() % spread).alias("_slice"))
    first = sliced.groupBy(*keys, "_slice").applyInPandas(add, f"{schema}, {value} array<double>")
    return first.groupBy(*keys).applyInPandas(add, f"{schema}, {value} array<double>")


class Shipped:
    """A value of bounded size sent to every executor once, classes of this folder included."""

    def __init__(self, spark: SparkSession, value):
        self.shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self, "_value"):
            self._value = cloudpickle.loads(self.shared.value)
        return self._value

    def __getstate__(self):
        return {"shared": self.shared}
