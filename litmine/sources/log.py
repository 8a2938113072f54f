"""A table that grows by numbered steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Log:
    """A table whose rows are written by numbered steps into ``root/step=n``; a step is written whole, again if need be."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._fs().mkdirs(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def steps(self) -> list[int]:
        """Numbers of the steps that have been written to their end."""
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(self._path(self.root))]
        return sorted(int(n[5:]) for n in names if n.startswith("step=") and fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def write(self, rows: DataFrame, step: int, *parts: str) -> None:
        """Write a step, in folders by the columns ``parts``, if any."""
        rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.root}/step={step}")

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of the finished steps, of those before a number if one is given."""
        done = [n for n in self.steps() if before is None or n < before]
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.option("basePath", self.root).schema(self.schema).parquet(*[f"{self.root}/step={n}" for n in done])

    def one(self, step: int) -> DataFrame:
        """Rows of one step."""
        return self.read().filter(f"step = {step}")

    def drop(self, steps: list[int]) -> None:
        for n in steps:
            self._fs().delete(self._path(f"{self.root}/step={n}"), True)
