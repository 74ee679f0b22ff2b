"""A persisted inverted index of rows as text, with BM25 search that reads only what can matter.

Built once per store, under a folder of its own:
  documents  number, table_name, row_id, columns, values, text, ordered by (table_name, row_id); numbers have that order
  postings   a row a block of up to BLOCK postings of a term: term, block, n, most, docs (number, weight), heaviest first;
             `most` is the block's greatest weight; in folders by bucket of the term
  terms      term, bucket, df
  stats      n_docs, avgdl, buckets

A posting's weight is what BM25 makes of its count and its document's length; the question adds how often it has the term
and how rare that is. A search reads the buckets of its terms. From the first block of each term follows a score that k
documents reach at least. Terms that even together cannot reach it name no candidates, and of the other terms only the blocks
that can together with the rest; candidates alone are then scored in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.session import hadoop, held, kept, shared_dir, written

#: The ranking's parameters.
K1 = 1.5
B = 0.75
#: Postings of a block, and buckets of terms at least; an index of more terms has one for each TERMS.
BLOCK, BUCKETS, TERMS = 128, 32, 1 << 20
#: Scores are rounded to six places, so two that differ by less may be equal.
SLACK = 1e-6
#: Candidates that are broadcast at most (two numbers each); more meet the postings in a shuffle.
BROADCAST_CANDIDATES = 500_000
#: The tables' columns, so that opening one reads no footer.
SCHEMAS = {
    "documents": "table_name string, row_id string, columns array<string>, values array<string>, text string, number long",
    "postings": "term string, block long, n int, most double, docs array<struct<number: long, weight: double>>, bucket int",
    "terms": "term string, df long, bucket int",
    "stats": "n_docs long, avgdl double, buckets int",
}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters a-z and digits, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        return self.table("documents")

    def terms(self) -> DataFrame:
        """term, df."""
        return self.table("terms").select("term", "df")

    def stats(self) -> DataFrame:
        """n_docs, avgdl."""
        return self.table("stats").select("n_docs", "avgdl")

    def search(self, questions: DataFrame, top_k: int = 8) -> DataFrame:
        """question_id, rank, table_name, row_id, score of the best documents of each question; equal scores are in order of (table_name, row_id)."""
        facts = self.table("stats").first()
        split = questions.select("question_id", F.explode(tokens(F.col("question"))).alias("term"))
        counted = held(split.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("bucket", bucket_of(F.col("term"), facts.buckets)))
        buckets = [r[0] for r in counted.select("bucket").distinct().collect()]  # no more than the index has
        asks = F.col("bucket").isin(buckets)
        idf = F.log(1 + (F.lit(facts.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = held(self.table("terms").where(asks).drop("bucket").join(counted, "term").select("question_id", "term", (F.col("times") * idf).alias("gain")))
        blocks = self.table("postings").where(asks).join(asked, "term")
        reach = held(self._reach(blocks, top_k))
        named = blocks.join(reach.drop("gain"), ["question_id", "term"])
        can = F.col("essential") & (F.col("gain") * F.col("most") + F.col("others") >= F.col("least") - SLACK)
        sizes = named.agg(F.sum(F.when(can, F.col("n"))).alias("some"), F.sum("n").alias("all")).first()
        postings = blocks.select("question_id", "gain", F.explode("docs").alias("d")).select("question_id", (F.col("gain") * F.col("d.weight")).alias("part"), F.col("d.number").alias("number"))
        if (sizes["some"] or 0) * 2 < (sizes["all"] or 0):
            candidates = held(named.where(can).select("question_id", F.explode("docs.number").alias("number")).distinct())
            hint = "broadcast" if candidates.count() <= BROADCAST_CANDIDATES else "shuffle_hash"
            postings = postings.join(candidates.hint(hint), ["question_id", "number"], "left_semi")
        scored = postings.groupBy("question_id", "number").agg(F.round(F.sum("part"), 6).alias("score"))
        order = Window.partitionBy("question_id").orderBy(F.desc("score"), "number")
        best = held(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k))
        return self.named(best).select("question_id", "rank", "table_name", "row_id", "score")

    @staticmethod
    def _reach(blocks: DataFrame, top_k: int) -> DataFrame:
        """question_id, term, gain, others, least, essential.

        least: a score that top_k documents of the question have at least, as that many have so heavy a posting of one term. others:
        what the question's other terms can add. essential: whether documents with this term, and lighter ones, can get there.
        """
        heads = blocks.where("block = 0").select("question_id", "term", "gain", (F.col("gain") * F.col("most")).alias("upper"), F.coalesce(F.get("docs.weight", F.lit(top_k - 1)), F.lit(0.0)).alias("kth"))
        question = Window.partitionBy("question_id")  # a row a term of a question
        upward = question.orderBy("upper", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        least = F.max(F.col("gain") * F.col("kth")).over(question)
        return heads.select("question_id", "term", "gain", (F.sum("upper").over(question) - F.col("upper")).alias("others"), least.alias("least"), (F.sum("upper").over(upward) >= least - SLACK).alias("essential"))

    def named(self, found: DataFrame) -> DataFrame:
        """Rows with a document's number, with its table_name, row_id, columns and values; the range of the numbers is pushed into the scan."""
        few = found.agg(F.min("number").alias("a"), F.max("number").alias("b")).first()
        near = self.documents().where(F.col("number").between(F.lit(few.a), F.lit(few.b)))
        return found.join(near.select("number", "table_name", "row_id", "columns", "values"), "number")


def build(docs: DataFrame, path: str | None = None) -> Index:
    """Index documents (table_name, row_id, columns, values, text) under a folder; a null text has no terms."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}"
    ordered = docs.repartitionByRange("table_name", "row_id").sortWithinPartitions("table_name", "row_id")
    ordered.withColumn("number", F.monotonically_increasing_id()).write.option("parquet.block.size", 1 << 24).parquet(f"{path}/documents")
    store = Index(spark, path)
    split = store.documents().select("number", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    split = kept(split.select("number", F.size("t").alias("dl"), "t"), "tokens")
    facts = split.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    avgdl = facts.avgdl or 1.0
    counted = split.select("number", "dl", F.explode("t").alias("term")).groupBy("number", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    weighed = kept(counted.select("term", "number", weight.alias("weight")), "weights")
    terms = weighed.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = kept(terms, "terms")
    buckets = max(BUCKETS, terms.count() // TERMS)
    terms.select("term", "df", bucket_of(F.col("term"), buckets).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    _blocks(weighed, buckets).write.partitionBy("bucket").parquet(f"{path}/postings")
    facts = spark.createDataFrame([(facts.n_docs, facts.avgdl, buckets)], "n_docs long, avgdl double, buckets int")
    facts.coalesce(1).write.parquet(f"{path}/stats")  # last: an index without it is not whole
    return store


def _blocks(weighed: DataFrame, buckets: int) -> DataFrame:
    """Postings in blocks, heaviest first; a range of (term, weight) a task, so a frequent term is cut by many and none holds it.

    Blocks are cut within a task; a term's blocks are numbered by a prefix sum over its tasks.
    """
    n = int(weighed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = weighed.repartitionByRange(n, "term", F.desc("weight"), "number").withColumn("task", F.spark_partition_id())
    dealt = kept(dealt, "dealt")
    place = Window.partitionBy("task", "term").orderBy(F.desc("weight"), "number")
    cut = dealt.withColumn("cut", F.floor((F.row_number().over(place) - 1) / BLOCK))
    item = F.struct((-F.col("weight")).alias("down"), "number")
    made = cut.groupBy("task", "term", "cut").agg(F.sort_array(F.collect_list(item)).alias("items"))  # BLOCK items at most
    sums = dealt.groupBy("term", "task").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("m"))
    before = Window.partitionBy("term").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("term", "task", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    docs = F.transform("items", lambda x: F.struct(x["number"].alias("number"), (-x["down"]).alias("weight")))
    joined = made.join(bases, ["term", "task"]).select("term", (F.col("base") + F.col("cut")).alias("block"), F.size("items").alias("n"), docs.alias("docs"))
    shown = joined.select("term", "block", "n", F.get("docs.weight", F.lit(0)).alias("most"), "docs", bucket_of(F.col("term"), buckets).alias("bucket"))
    return shown.repartition("bucket", F.pmod("block", F.lit(16))).sortWithinPartitions("bucket", "term", "block")


def fingerprint(spark: SparkSession, folder: str, names: list[str]) -> str:
    """Of the files of a folder's tables, by path, size and time."""
    import hashlib

    seen = []
    for name in sorted(names):
        system, where = hadoop(spark, f"{folder}/{name}.parquet")
        files = system.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:24]


def of_store(spark: SparkSession, name: str, docs: Callable[[], DataFrame]) -> Index:
    """The index of that name in the shared folder, built where there is none; one that was left half built is passed over."""
    at = f"{shared_dir(spark)}/indexes/{name}"
    system, where = hadoop(spark, at)
    if system.exists(where):
        for f in system.listStatus(where):
            path = f.getPath().toString()
            if written(spark, f"{path}/stats"):
                return Index(spark, path)
    return build(docs(), f"{at}/{uuid.uuid4().hex[:12]}")
