"""Keyed tables that ticks keep between them, in a folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpline.plans.checkpoints import delete_folder


class KeptTable:
    """The newest row of each key.  A tick writes only rows that change.

    ``change=E`` holds what tick E wrote, ``base=E`` all rows as they were after it.  A tick sees the newest base before it and the
    changes since, so one that is run again sees what it saw the first time, and writes its own folder again; a folder that was
    never finished doesn't count.  Every ``compact_every`` ticks a new base is written, and what lies before the one before it goes.
    Rows whose ``gone`` is true are left out, and are no longer there after the next base.  ``part`` is a column of the key by which
    files are laid out: a condition on it reads only folders that it names.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...], schema: str, part: str | None = None, compact_every: int = 16):
        self.spark, self.folder, self.keys, self.part, self.compact_every = spark, folder, list(keys), part, compact_every
        self.schema = StructType.fromDDL(f"{schema}, gone boolean")

    def _epochs(self, kind: str) -> list[int]:
        """Ticks that finished a folder of this kind; as many as there are since the last base but one."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found or ())

    def _all(self, epoch: int, base_before: int | None = None) -> DataFrame:
        base = max((e for e in self._epochs("base") if e < (epoch if base_before is None else base_before)), default=None)
        since = [e for e in self._epochs("change") if (base is None or e > base) and e < epoch]
        columns = self.schema.names
        old = self.spark.createDataFrame([], self.schema) if base is None else self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/base={base}").parquet(f"{self.folder}/base={base}").select(*columns)
        if not since:
            return old
        one = self.spark.read.schema(StructType([*self.schema.fields]).add("change", "long")).option("basePath", self.folder).parquet(*[f"{self.folder}/change={e}" for e in since])
        rest = [c for c in columns if c not in self.keys]
        new = one.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "change").alias("r")).select(*self.keys, "r.*").select(*columns)
        return new if base is None else old.join(new.select(*self.keys), self.keys, "left_anti").select(*columns).unionByName(new)

    def before(self, epoch: int) -> DataFrame:
        """The table as tick ``epoch`` finds it."""
        return self._all(epoch).where(~F.coalesce("gone", F.lit(False))).drop("gone")

    def write(self, rows: DataFrame, epoch: int) -> None:
        """The rows that tick ``epoch`` changes, one a key; a column ``gone`` may be left out."""
        if "gone" not in rows.columns:
            rows = rows.withColumn("gone", F.lit(False))
        w = rows.select(*self.schema.names).write.mode("overwrite")
        (w.partitionBy(self.part) if self.part else w).parquet(f"{self.folder}/change={epoch}")
        if (epoch + 1) % self.compact_every == 0:
            self._compact(epoch)

    def _compact(self, epoch: int) -> None:
        whole = self._all(epoch + 1, epoch).where(~F.coalesce("gone", F.lit(False)))
        w = (whole.repartition(self.part) if self.part else whole).write.mode("overwrite")
        (w.partitionBy(self.part) if self.part else w).parquet(f"{self.folder}/base={epoch}")
        earlier = [e for e in self._epochs("base") if e < epoch]
        if earlier:  # a tick that is run again needs the last base before it
            for kind, least in (("base", earlier[-1] - 1), ("change", earlier[-1])):
                for e in self._epochs(kind):
                    if e <= least:
                        delete_folder(self.spark, f"{self.folder}/{kind}={e}")
