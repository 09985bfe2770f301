"""Exact deduplication by a stateful stream with disk-backed keyed state.

Documents are landed as small rows (digest, stable identifier, content locator).
A stream reads what has landed and keeps, for each digest and without expiry, the
identifier that stays, its locator and the number of copies in a RocksDB state
store.  Partial aggregates are formed before the shuffle, so a digest shared by a
third of all rows reaches its state as one row for each task.  Rows whose digest
was hit are then compared with the kept text byte by byte; where two texts share
a digest, their rows are grouped by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balanza.llm.common import Scratch, lower_ascii

#: Settings of the stream; what was set before is put back afterwards.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # A store is closed when its task has committed: open ones would each hold memory and 4 MB of local disk.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


class ExactDedup:
    """Deduplication state that lives below the shared folder and takes further documents at any time.

    ``digest_chars``: hex digits of the SHA-256 used as state key; fewer digits only
    make collisions, which the byte check resolves.  ``batch_bytes`` bounds the
    landed bytes of one micro-batch.  The state has ``state_partitions`` partitions for
    good; by default one for each million rows of the first documents, 8 at least.
    """

    def __init__(self, spark: SparkSession, digest_chars: int = 64, batch_bytes: int = 8 << 30, state_partitions: int | None = None):
        self.spark, self.digest_chars, self.batch_bytes = spark, digest_chars, batch_bytes
        self.state_partitions = state_partitions
        self.scratch = Scratch(spark, "exact-dedup")

    def _digest(self) -> Column:
        return F.substring("text_sha256", 1, self.digest_chars)

    def ingest(self, docs: DataFrame) -> None:
        """Land ``docs`` (doc_id, text) and bring the state up to date."""
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(lower_ascii(F.col("text")), 256).alias("text_sha256"),
            F.input_file_name().alias("locator"),
        )
        rows.write.mode("append").parquet(self.scratch.path("landed"))
        self._advance(rows.schema)

    def _advance(self, schema) -> None:
        spark = self.spark
        if self.state_partitions is None:
            self.state_partitions = max(8, -(-self.landed().count() // 1_000_000))
        settings = STATE | {"spark.sql.shuffle.partitions": str(self.state_partitions)}
        before = {k: spark.conf.get(k, None) for k in settings}
        updates = self.scratch.path("updates")

        def write(batch: DataFrame, number: int) -> None:
            # One folder for each micro-batch: a batch run again after a failure replaces its own rows.
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            landed = spark.readStream.schema(schema).option("maxBytesPerTrigger", self.batch_bytes).parquet(self.scratch.path("landed"))
            state = landed.groupBy(self._digest().alias("digest")).agg(
                F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size")
            )
            query = (
                state.writeStream.outputMode("update")
                .trigger(availableNow=True)
                .option("checkpointLocation", self.scratch.path("state"))
                .foreachBatch(write)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def landed(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, text_sha256 string, locator string").parquet(self.scratch.path("landed"))

    def groups(self) -> DataFrame:
        """The state: digest, keep (doc_id, locator), group_size.  Both grow only, so the largest is the latest."""
        schema = "digest string, keep struct<doc_id: long, locator: string>, group_size long, batch int"
        rows = self.spark.read.schema(schema).parquet(self.scratch.path("updates"))
        return rows.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))

    def result(self, docs: DataFrame) -> DataFrame:
        """One row for each landed row; ``docs`` are the landed documents, read again where a digest was hit.

        Columns: doc_id, keep_id, group_size, kept, text_sha256.
        """
        groups = self.scratch.keep(self.groups(), "groups")
        landed = self.landed().withColumn("digest", self._digest())
        out = landed.join(groups.select("digest", F.col("keep.doc_id").alias("keep_id"), "group_size"), "digest")
        collided = self._collided(docs, groups)
        if not collided.isEmpty():
            exact = self._by_text(docs, collided)
            out = out.join(collided, "digest", "left_anti").drop("digest").unionByName(exact)
        return out.select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
        )

    def _texts(self, docs: DataFrame) -> DataFrame:
        norm = lower_ascii(F.col("text"))
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).withColumn(
            "text_sha256", F.sha2("norm", 256)
        )

    def _collided(self, docs: DataFrame, groups: DataFrame) -> DataFrame:
        """Digests under which different texts were found, from the full bytes of every hit."""
        hit = groups.filter("group_size > 1").select("digest", F.col("keep.doc_id").alias("keep_id"))
        texts = self._texts(docs).withColumn("digest", self._digest())
        rows = self.scratch.keep(texts.join(hit, "digest").select("doc_id", "keep_id", "digest", "norm"), "hits")
        kept = rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("kept"))
        differ = rows.join(kept, "digest").filter(F.col("norm") != F.col("kept"))
        return self.scratch.keep(differ.select("digest").distinct(), "collided")

    def _by_text(self, docs: DataFrame, collided: DataFrame) -> DataFrame:
        rows = self._texts(docs).withColumn("digest", self._digest()).join(collided, "digest")
        sizes = rows.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        return rows.join(sizes, "norm").select("doc_id", "text_sha256", F.lit("").alias("locator"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so
    null and empty texts form one group.  The row with the largest doc_id stays; a
    null id is below all others and stays only in a group of null ids.  Repeated rows
    (same text and id) count in group_size and are all marked as kept, because they
    are the same document.  Other columns are ignored; an empty table gives none.
    """
    run = ExactDedup(docs.sparkSession, digest_chars)
    run.ingest(docs)
    return run.result(docs)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged; rows repeated with one id and text stay once."""
    scratch = Scratch(docs.sparkSession, "kept")
    kept = scratch.keep(exact_dedup(docs).filter("kept").groupBy("doc_id", "text_sha256").count(), "kept")
    sha = F.sha2(lower_ascii(F.col("text")), 256)
    of, kept_sha = kept["doc_id"], kept["text_sha256"]
    out = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(of) & (sha == kept_sha), "left_semi")
    if kept.filter("count > 1").isEmpty():
        return out
    # Only here are whole rows shuffled once more.
    return out.withColumn("_norm", lower_ascii(F.col("text"))).dropDuplicates(["doc_id", "_norm"]).drop("_norm")
