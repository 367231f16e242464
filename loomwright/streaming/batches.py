"""A table that a stream's micro-batches are written to, each once, however often it is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class BatchTable:
    """Folders ``<path>/<part>/query=<name>/batch=<id>``, one for each part of a micro-batch.

    A micro-batch is committed once the success marker of its last part is there. What an interrupted one left
    behind is overwritten when it is replayed and is never read before. ``parts`` are in the order of writing.
    """

    def __init__(self, spark: SparkSession, path: str, parts: tuple[str, ...] = ("rows",)):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def folder(self, part: str, query: str, batch: int) -> str:
        return f"{self.path}/{part}/query={query}/batch={batch}"

    def _glob(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [x.getPath().getParent().toString() for x in found or []]

    def is_committed(self, query: str, batch: int) -> bool:
        return bool(self._glob(f"{self.folder(self.parts[-1], query, batch)}/_SUCCESS"))

    def committed(self) -> list[tuple[str, int]]:
        """(query, batch) of all committed micro-batches."""
        names = [x.rsplit("/", 2)[1:] for x in self._glob(f"{self.path}/{self.parts[-1]}/query=*/batch=*/_SUCCESS")]
        return sorted((query.split("=", 1)[1], int(batch.split("=", 1)[1])) for query, batch in names)

    def write(self, part: str, rows: DataFrame, query: str, batch: int, by: str | None = None) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(self.folder(part, query, batch))

    def read(self, part: str, schema: str, batches: list[tuple[str, int]] | None = None, below: str | None = None) -> DataFrame:
        """The rows of ``part`` in committed micro-batches, or in ``batches`` alone, with their query and batch."""
        some = self.committed() if batches is None else batches
        full = f"{schema}, query string, batch long"
        if not some:
            return self.spark.createDataFrame([], full)
        reader = self.spark.read.schema(full).option("basePath", f"{self.path}/{part}")
        return reader.parquet(*(self.folder(part, *x) for x in some))
