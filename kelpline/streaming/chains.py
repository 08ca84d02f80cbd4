"""Hash chains that go on from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators.provenance import GENESIS, build_chain
from kelpline.plans.checkpoints import checkpointed
from kelpline.streaming.kept import KeptTable

HEAD = "source_id int, id long, payload_sha string, chain_sha string"


class ForkedChain(ValueError):
    """Somebody else has moved a source's head, or a record that is chained already comes with another payload."""


class KeptChain:
    """Links of all sources in a folder, one a batch, and each source's head as a kept table."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 16):
        self.spark, self.folder = spark, folder
        self.heads = KeptTable(spark, f"{folder}/heads", ("source_id",), HEAD, compact_every=compact_every)

    def links(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/links").drop("batch")

    def append(self, log: DataFrame, batch: int, expected: DataFrame | None = None) -> None:
        """Chains the records (source_id, id, payload) of a batch behind the heads as the batches before it left them.

        ``expected`` (source_id, chain_sha) are the heads that the writer goes by: where one has moved since, nothing is written.
        Records at the head or behind it have been chained; of those the head's own is compared.  A batch that is run again
        reads the heads that it read the first time, and writes the same links again."""
        heads = self.heads.before(batch)
        if expected is not None:
            e = expected.select("source_id", F.coalesce("chain_sha", F.lit(GENESIS)).alias("thought"))
            moved = e.join(heads.select("source_id", "chain_sha"), "source_id", "left").where(F.coalesce("chain_sha", F.lit(GENESIS)) != F.col("thought")).select("source_id").orderBy("source_id").limit(5).collect()
            if moved:
                raise ForkedChain(f"heads have moved of sources {[r.source_id for r in moved]}")
        at = heads.select("source_id", F.col("id").alias("head_id"), F.col("payload_sha").alias("head_payload"))
        rows = log.select("source_id", "id", "payload").join(at, "source_id", "left")
        other = rows.where((F.col("id") == F.col("head_id")) & (F.sha2(F.col("payload").cast("binary"), 256) != F.col("head_payload"))).select("source_id").distinct().orderBy("source_id").limit(5).collect()
        if other:
            raise ForkedChain(f"another payload under the head's id, of sources {[r.source_id for r in other]}")
        links = checkpointed(build_chain(rows.where(F.col("head_id").isNull() | (F.col("id") > F.col("head_id"))).drop("head_id", "head_payload"), heads))
        links.write.mode("overwrite").parquet(f"{self.folder}/links/batch={batch}")
        last = links.groupBy("source_id").agg(F.max_by(F.struct("id", "payload_sha", "chain_sha"), "id").alias("l")).select("source_id", "l.*")
        self.heads.write(last, batch)
