"""Exact deduplication by a stateful stream, in DataFrame operations only.

A stream of (digest, doc_id, content locator) rows is grouped by digest. Its state lives on disk in RocksDB, has no
watermark and so never expires: per digest it retains the smallest row (doc_id, then locator) and the number of rows.
Rows are combined per task before the shuffle, so a digest that a third of all rows share is no hot key. Digests that
were hit more than once, which each task knows by a bitmap of bounded size, are then checked on the full bytes of the normalised texts: a digest of several distinct texts
fails the check and is grouped by its texts instead. Distinct texts are found per task first, so that copies of one
text never meet in one task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import settings, shared_path, written

#: Settings of the stream. The state is many small stores: no disk is allocated ahead for each, what a batch changed is
#: what it saves, and the stores of an executor share one bound of memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: Files of digests that one micro-batch reads.
FILES_PER_BATCH = 10_000

#: Bits for the digests that were hit again: 8 MB. Beyond some hundred million of them more unique texts join the check.
BITS = 1 << 26

STREAMED = "digest string, doc_id long, file string, row long"


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of the six ASCII white-space characters is one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of ``docs`` and the rows' locators: ``file``, the file's path, and ``row``, the place in it."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(*columns, meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def whole(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def from_files(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it reads Parquet files, whose rows have lasting places; else written to the shared folder first."""
    try:
        located(docs)
        return docs
    except AnalysisException:
        return written(docs, "dedup-input")


def digests(docs: DataFrame, digest=sha256) -> DataFrame:
    return located(docs, digest(normalised(docs["text"])).alias("digest"), docs["doc_id"].cast("long").alias("doc_id"))


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def stream_keepers(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stream ``rows`` (STREAMED) to its present end: every batch appends the digests that it changed to ``out``.

    Called again with the same ``checkpoint`` it goes on where it stopped, with the state that it had.
    """
    spark = rows.sparkSession
    changed = rows.groupBy("digest").agg(F.min(_rank()).alias("keep"), F.count("*").alias("group_size"))

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a batch that is run again replaces itself

    with settings(spark, STATE):
        query = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()


def read_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return spark.readStream.schema(STREAMED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keepers(spark: SparkSession, out: str) -> DataFrame:
    """digest, keep (struct), group_size: the last state of each digest. State only falls (keep) and rises (group_size)."""
    schema = "digest string, keep struct<no_id:boolean,doc_id:long,file:string,row:long>, group_size long, batch int"
    changes = spark.read.schema(schema).parquet(out)
    return changes.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))


def _place() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(BITS)) + 1


def hit_bits(state: DataFrame) -> DataFrame:
    """bucket, bits: a bit for each digest that was hit again, at a hashed place. All buckets are BITS / 8 bytes at most,
    whatever the table's size, so every task can have them: a text whose bit is not set is unique and goes nowhere."""
    hit = state.where("group_size > 1").select(_place().alias("place"))
    return hit.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def _bit() -> Column:
    """Whether the digest's bit is set in its bucket."""
    position = F.bitmap_bit_position(_place())
    byte = F.conv(F.hex(F.substring("bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))), F.lit(2)) == 1


def decide(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, file, row, digest, keep (struct of the row that stays), group_size.

    ``docs`` has doc_id and text; further columns are not read. ``digest`` can be replaced by a weaker function: results
    stay exact, by the check of the full bytes.
    """
    spark = docs.sparkSession
    docs = from_files(docs)
    path = shared_path(spark, "digests")
    digests(docs, digest).write.parquet(path)
    rows = spark.read.schema(STREAMED).parquet(path)
    changes = shared_path(spark, "keepers")
    stream_keepers(read_stream(spark, path), changes, shared_path(spark, "dedup-state"))
    if not rows.limit(1).count():
        return rows.withColumns({"keep": F.lit(None).cast("struct<no_id:boolean,doc_id:long,file:string,row:long>"), "group_size": F.lit(0).cast("long")})
    state = written(keepers(spark, changes), "dedup-keepers")
    text = normalised(docs["text"])
    texts = located(docs, digest(text).alias("digest"), text.alias("text"))
    hits = texts.join(F.broadcast(hit_bits(state)), F.bitmap_bucket_number(_place()) == F.col("bucket")).where(_bit()).select("digest", "text")
    clashes = hits.distinct().groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    clashes = written(clashes, "dedup-clashes")
    if not clashes.limit(1).count():
        return rows.join(state, "digest")
    own = texts.join(clashes, "digest", "left_semi").select("file", "row", "text")
    own = rows.join(own, ["file", "row"])
    exact = own.groupBy("digest", "text").agg(F.min(_rank()).alias("keep"), F.count("*").alias("group_size"))
    return rows.join(clashes, "digest", "left_anti").join(state, "digest").unionByName(own.join(exact, ["digest", "text"]).drop("text"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``, dropped rows too.

    Texts are equal when they are after normalisation; of equal texts the row with the smallest doc_id stays. Null texts
    count as empty, so they are one group, apart from a lone space. A null doc_id ranks last; its keep_id is null only if
    no row of the group has one. Of rows that repeat a doc_id and a text, the first by file and place stays: exactly one
    row of each group has kept = true. An empty table gives no rows.
    """
    rows = decide(docs)
    kept = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = from_files(docs)
    kept = decide(docs).where((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row")))
    return located(docs, whole(docs)).join(kept.select("file", "row"), ["file", "row"], "left_semi").select("doc.*")
