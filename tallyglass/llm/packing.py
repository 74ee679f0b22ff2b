"""Packing documents into sequences by best-two-fit.

Pieces of equal length are interchangeable, so the packing is planned on the histogram of piece lengths: at most
`capacity` counts, whatever the corpus. The plan is a list of bin patterns with multiplicities. Each bin is filled
greedily (largest piece first, then the largest that fits); then its smallest piece is replaced by the two unpacked
pieces whose sum comes closest to the gap that opens. The pieces of each length are numbered over the whole corpus,
in buckets so that a length held by a third of all rows is numbered by many tasks, and each number is looked up in
the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm import pretokens
from tallyglass.llm.common import lean, materialize, text_of
from tallyglass.llm.token_files import id_type

CAPACITY = 4096
END_ID = 1
#: Buckets in which the pieces of one length are numbered, at least, and pieces of the commonest length for each bucket.
RANK_BUCKETS = 512
BUCKET_PIECES = 1 << 18


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids with `end_id`, cut only where longer than `capacity`: doc_id, piece, start, length, ids_crc32."""
    with open(tokenizer, encoding="utf-8") as f:
        tokenizer_json = f.read()
    dtype = id_type(tokenizer_json, end_id)
    tok = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = pretokens.packed_ids(tok.value, dtype), np.array([end_id], dtype).tobytes()
        for batch in batches:
            out = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), cache.values(pretokens.texts_of(batch.column(1))), strict=True):
                ids = np.frombuffer(packed + end, dtype).astype("<u4")
                out += [(doc_id, k, at, len(x := ids[at : at + capacity]), zlib.crc32(x)) for k, at in enumerate(range(0, len(ids), capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit over a histogram: [(bins, [(length, how many in each bin), ...]), ...]."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        used: Counter = Counter()
        largest = _largest(left)
        gap = capacity
        while length := largest[gap]:
            take = int(min(left[length], gap // length))
            used[int(length)] += take
            left[length] -= take
            gap -= take * int(length)
            if not left[length]:
                largest = _largest(left)
        while sum(used.values()) > 1:
            smallest = min(used)
            pair = _best_pair(left, largest, gap + smallest)
            if sum(pair) <= smallest:
                break
            used[smallest] -= 1
            left[smallest] += 1
            used += Counter()
            for length in pair:
                used[length] += 1
                left[length] -= 1
            gap -= sum(pair) - smallest
            largest = _largest(left)
        more = int(min(left[length] // n for length, n in used.items()))
        for length, n in used.items():
            left[length] -= more * n
        plan.append((1 + more, sorted(used.items(), reverse=True)))
    return plan


def _largest(left: np.ndarray) -> np.ndarray:
    """At each size, the largest length in stock that is no larger; 0 if none."""
    return np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))


def _best_pair(left: np.ndarray, largest: np.ndarray, room: int) -> tuple[int, int]:
    """The two unpacked pieces with the largest sum within `room`; (0, 0) if there are none."""
    first = np.flatnonzero(left[: room + 1])
    first = first[first > 0]
    if not len(first):
        return 0, 0
    second = largest[room - first]
    alone = (second == first) & (left[first] < 2)
    second = np.where(alone, largest[np.maximum(np.minimum(room - first, first - 1), 0)], second)
    sums = np.where(second > 0, first + second, 0)
    best = int(sums.argmax())
    return (int(first[best]), int(second[best])) if sums[best] else (0, 0)


def lay_out(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as a table sorted by (length, first number): which numbers of a length go to which bins and offsets."""
    rows, taken, sequence = [], Counter(), 0
    for bins, used in plan:
        offset = 0
        for length, n in used:
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += bins * n
            offset += n * length
        sequence += bins
    names = ("length", "first", "each", "sequence", "offset")
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: table[:, i].copy() for i, name in enumerate(names)}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and packs as `end_id` alone. Null doc_ids and repeated rows are packed like any other. Other
    columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(lay_out(plan_bins(counts, capacity)))

    buckets = max(buckets, -(-max(counts.values(), default=0) // BUCKET_PIECES))
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = bucketed.withColumn("number", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("base")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t["length"] << 48 | t["first"]
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(key, length << 48 | number, side="right") - 1
            q = number - t["first"][at]
            sequence = t["sequence"][at] + q // t["each"][at]
            offset = t["offset"][at] + q % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
