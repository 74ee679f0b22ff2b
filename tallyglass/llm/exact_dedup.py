"""Exact deduplication as a stateful stream: disk-backed keyed state, no expiry, full bytes checked on hits.

Each call adds its documents to a content store, one folder a batch: digest of the normalised text, identifier, length,
row number and the text itself. A content locator is (batch, row). The slim columns of the store are streamed into a
RocksDB-backed state keyed by digest that never expires; per digest it holds the row that stays with its identifier,
the locator of the content that was seen first, and the number of rows. Partial aggregation runs before the shuffle, so
a digest that holds a third of all rows costs one state row a task. A later call with the same checkpoint reads its new
batch alone into the state.

A hit is a digest of the batch that has more than one row. The content of hits only is fetched: the batch's own rows and,
by locator, what was seen first; the least and the greatest text of each digest must be the same bytes. Every row is so
held against the first content of its digest, whichever batch that came in. Where two texts ever share a digest, the
digest is kept in a list of clashes, and its rows of all batches are regrouped by the text itself.

A call may be made again. It has a name, the caller's or a hash of its rows; the name is listed with a batch number before
anything is written, so a call made twice is one batch. A batch is written if its content is not whole, streamed as far as
the state has not seen it, and checked for clashes if that is not on record; a call first throws away what an earlier one left
half written and checks what an earlier one left unchecked. One call at a time may use a checkpoint.

Everything is DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm.common import ASCII_SPACE, PARQUET, children, fresh, located, materialize, scratch, text_of, without

#: Keyed state on the executors' disks; each commit uploads its changes and closes the store: an open one preallocates 4 MB.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}

#: On a mounted folder the default manager starts a `readlink` process for every file of every store.
LOCAL_SETTINGS = {
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}

#: Hits up to this many are broadcast (32 bytes of digest and a locator each); more are shuffled, and their texts with them.
BROADCAST_HITS = 200_000

RECORD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("chars", T.IntegerType()),
        T.StructField("row", T.LongType()),
        T.StructField("batch", T.IntegerType()),
    ]
)
CONTENT = T.StructType([*RECORD.fields[:-1], T.StructField("norm", T.StringType()), RECORD["batch"]])


def normalised(column: str = "text") -> Column:
    """The text without any character of `[\\x20\\x09-\\x0D]`; null is empty."""
    return F.translate(text_of(column), ASCII_SPACE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def rank() -> Column:
    """Greatest for the row that stays: most code points, then smallest doc_id (null last), then first locator."""
    return F.struct(
        F.col("chars"),
        F.col("doc_id").isNotNull().alias("has_id"),
        F.bitwise_not(F.col("doc_id")).alias("not_id"),
        F.bitwise_not(F.col("batch")).alias("not_batch"),
        F.bitwise_not(F.col("row")).alias("not_row"),
    )


def locator() -> Column:
    return F.struct("batch", "row")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    system, where = _folder(spark, f"{path}/_SUCCESS")
    return bool(system.exists(where))


def call_name(docs: DataFrame) -> str:
    """A name for these rows, in whatever order and partitions: their number, and sums of two hashes of each."""
    h = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_of()), 256), 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")) for k in (0, 1)]
    r = docs.agg(F.count(F.lit(1)), *h).first()
    return "-".join(str(x or 0) for x in r)


def calls(spark: SparkSession, base: str) -> dict[str, int]:
    """Batch numbers of the calls listed at a checkpoint."""
    return {name: int(n) for n, _, name in (x.partition("-") for x in children(spark, f"{base}/calls"))}


def add_batch(docs: DataFrame, base: str, digest: Callable[[Column], Column] = sha256, row: str | None = None, call: str | None = None) -> int:
    """Write the documents to the content store as the batch of this call, unless they are there; returns the batch's number. `row` names a column of row numbers."""
    spark = docs.sparkSession
    name = call_name(docs) if call is None else sha2_name(call)
    known = calls(spark, base)
    if name not in known:
        known[name] = max(known.values(), default=-1) + 1
        system, where = _folder(spark, f"{base}/calls/{known[name]:08d}-{name}")
        system.mkdirs(where)
    batch = known[name]
    for other in known.values():
        if not _whole(spark, path := f"{base}/content/batch={other}"):  # what a call that failed left
            system, where = _folder(spark, path)
            system.delete(where, True)
    if _whole(spark, f"{base}/content/batch={batch}"):
        return batch
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        normalised().alias("norm"),
        F.char_length(text_of()).alias("chars"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
    )
    content = found.select("doc_id", digest(F.col("norm")).alias("digest"), "chars", "row", "norm")
    content.write.options(**PARQUET).parquet(f"{base}/content/batch={batch}")
    return batch


def sha2_name(call: str) -> str:
    """A caller's name as a folder can have it."""
    return hashlib.sha256(call.encode()).hexdigest()


def update_state(spark: SparkSession, base: str, max_files_per_trigger: int | None = None) -> None:
    """Stream what the state has not seen of the content store into it, then stop."""
    checkpoint = f"{base}/stream"
    settings = STATE_SETTINGS | (LOCAL_SETTINGS if checkpoint.startswith("file:") else {})
    keep = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(CONTENT)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        slim = reader.parquet(f"{base}/content").select(*RECORD.names)
        grouped = slim.groupBy("digest").agg(F.max(rank()).alias("best"), F.min(locator()).alias("first"), F.count(F.lit(1)).alias("rows"))
        query = grouped.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, base: str) -> DataFrame:
    """The keyed state as a table: digest, best (the rank of the row that stays), first (content locator), group_size."""
    state = spark.read.format("statestore").load(f"{base}/stream")
    best, first, rows = (f.name for f in state.schema["value"].dataType.fields)
    return state.select(
        F.col("key")[state.schema["key"].dataType.fields[0].name].alias("digest"),
        F.col("value")[best].alias("best"),
        F.col("value")[first].alias("first"),
        F.col("value")[rows].alias("group_size"),
    )


def check_batch(spark: SparkSession, base: str, batch: int, state: DataFrame) -> None:
    """Put the digests that different texts of this batch, or of this and an earlier one, share on record."""
    store = spark.read.schema(CONTENT).parquet(f"{base}/content")
    hits = state.where("group_size > 1").select("digest", "first")
    hits = hits.join(store.where(F.col("batch") == batch).select("digest").distinct(), "digest", "left_semi")
    hits = materialize(hits, "dedup-hits")
    named = [r[0] for r in hits.select("first.batch").distinct().collect()]
    few = hits.count() <= BROADCAST_HITS
    named_hits = hits.select(F.col("digest").alias("hit"), "first").hint("broadcast" if few else "shuffle_hash")
    texts = store.where(F.col("batch").isin([batch, *named])).select("digest", "batch", "row", "norm").join(named_hits, F.col("digest") == F.col("hit"))
    texts = texts.where((F.col("batch") == batch) | (locator() == F.col("first")))
    differ = texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where(F.col("lo") != F.col("hi"))
    differ.select("digest").write.mode("overwrite").parquet(f"{base}/clashes/batch={batch}")


def find_clashes(spark: SparkSession, base: str, state: DataFrame) -> DataFrame:
    """Digests that different texts share; every batch is checked that is not yet."""
    for batch in sorted(calls(spark, base).values()):
        if _whole(spark, f"{base}/content/batch={batch}") and not _whole(spark, f"{base}/clashes/batch={batch}"):
            check_batch(spark, base, batch, state)
    return spark.read.schema("digest binary, batch int").parquet(f"{base}/clashes").select("digest").distinct()


def _resolved(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    keep_id = F.when(F.col("best.has_id"), F.bitwise_not(F.col("best.not_id")))
    return rows.join(groups, on).select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("batch") == F.bitwise_not(F.col("best.not_batch"))) & (F.col("row") == F.bitwise_not(F.col("best.not_row")))).alias("kept"),
        "digest",
        "chars",
        "row",
    )


def decided(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = None,
    row: str | None = None,
    call: str | None = None,
) -> DataFrame:
    """exact_dedup() with `row`, the row number in the batch."""
    spark = docs.sparkSession
    base = (checkpoint or scratch(spark, "dedup")).rstrip("/")
    batch = add_batch(docs, base, digest, row, call if checkpoint else "the only one")
    update_state(spark, base, max_files_per_trigger)
    state = read_state(spark, base)
    store = spark.read.schema(CONTENT).parquet(f"{base}/content")
    rows = store.where(F.col("batch") == batch).select(*RECORD.names)
    clashes = find_clashes(spark, base, state)
    if clashes.isEmpty():
        return _resolved(rows, state, ["digest"])
    clashing = store.join(clashes, "digest", "left_semi")
    groups = clashing.groupBy("digest", "norm").agg(F.max(rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    regrouped = _resolved(clashing.where(F.col("batch") == batch), groups, ["digest", "norm"])
    return _resolved(rows.join(clashes, "digest", "left_anti"), state, ["digest"]).unionByName(regrouped)


def exact_dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = None,
    call: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest, chars.

    `docs` needs doc_id and text; other columns are ignored, whatever their names. Null text is the empty text. A null
    doc_id loses every tie; repeated rows, even with one doc_id, keep exactly one. An empty input gives an empty result.
    With a `checkpoint` of an earlier call the groups hold the rows of all calls: keep_id may name an earlier row, and
    a row that now stays takes the place of the one that an earlier call kept. A call that failed, or whose result was lost,
    is made again with the same rows, or under the same name `call`, and adds nothing twice; rows that are to be added
    again need a name of their own.
    """
    return decided(docs, digest, checkpoint, max_files_per_trigger, call=call).drop("row")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` without its dropped copies, all columns kept; of equal texts, repeated rows included, one row stays."""
    (at,) = fresh(docs.columns, "at")
    rows = located(docs, at)
    return without(rows, at, decided(rows, row=at).where("NOT kept").select("row")).select(*docs.columns)
