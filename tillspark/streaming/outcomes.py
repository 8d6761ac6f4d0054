"""What a job makes of its micro-batches: one write per batch, by outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

#: Topic rows that do not bind, with what they hold.
MALFORMED = "malformed"
REJECTED = "rejected"

_RAW = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
])


class Outcomes:
    """The output folder of one job: batch=n/outcome=name.

    A batch writes all its outcomes at once and overwrites what an earlier
    try left, so a batch that is run again changes nothing. Rows of
    different outcomes share the columns they have by name.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def write(self, batch: int, **outcomes: DataFrame) -> None:
        rows = None
        for name, part in outcomes.items():
            part = part.withColumn("outcome", F.lit(name))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{self.path}/batch={batch}")

    def read(self, outcome: str, schema: T.StructType | str, before: int | None = None) -> DataFrame:
        """Rows of one outcome with their `batch`, of all batches or those before one."""
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        whole = T.StructType([*schema.fields, T.StructField("outcome", T.StringType()), T.StructField("batch", T.LongType())])
        reader = self.spark.read.schema(whole).option("basePath", self.path)
        try:
            rows = reader.parquet(self.path)
        except AnalysisException:  # nothing was written yet
            rows = self.spark.createDataFrame([], whole)
        rows = rows.filter(F.col("outcome") == outcome).drop("outcome")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def of_batch(self, outcome: str, schema: T.StructType | str, batch: int) -> DataFrame:
        return self.read(outcome, schema).filter(F.col("batch") == batch).drop("batch")

    def malformed(self) -> DataFrame:
        return self.read(MALFORMED, _RAW).drop("batch")


def raw_rows(rows: DataFrame) -> DataFrame:
    """Topic rows as they are kept when they do not bind."""
    return rows.select(*_RAW.fieldNames())
