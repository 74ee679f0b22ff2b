"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

The hashes of a text's word shingles are computed once. Their top bits choose one of `BINS` bins and each bin keeps its
least hash. An empty bin takes the value of a filled one, which a sequence of hashes of (bin, attempt) chooses, the
same for every text. Of each bin's value the low `BITS` bits are stored. Two fingerprints' likeness is the share of
equal bins, corrected for the 2 ** -BITS of unequal bins that agree by chance.

Each text needs the next document's text. Documents are dealt out by ranges of doc_id, so neighbours meet in a task;
the first document of each range is also sent to the range before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import textbytes
from tallyglass.llm.common import lean, shuffle_partitions, text_of

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
LEAST_ID = -(1 << 63)


def probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    """The bin from which an empty bin is filled at an attempt."""
    return (textbytes.mix(bins.astype(np.uint64) + np.uint64(BINS) * np.uint64(attempt)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def densify(least: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a filled one."""
    out, rows = least.copy(), np.flatnonzero((least != EMPTY).any(axis=1))
    row, column = np.nonzero(least[rows] == EMPTY)
    row = rows[row]
    attempt = 0
    while len(row):
        attempt += 1
        value = least[row, probe(column, attempt)]
        hit = value != EMPTY
        out[row[hit], column[hit]] = value[hit]
        row, column = row[~hit], column[~hit]
    return out


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> list[bytes]:
    """BINS * BITS / 8 bytes for each text (binary or string column); no bytes for a text without words."""
    out: list[bytes] = []
    for i, j, data, offsets in textbytes.chunks(texts, rows=1024):
        h, owner = textbytes.shingle_hashes(textbytes.LOWER[data], offsets, size)
        least = np.full((j - i) * BINS, EMPTY, np.uint64)
        np.minimum.at(least, owner * BINS + (h >> np.uint64(64 - BIN_BITS)).astype(np.int64), h)
        least = least.reshape(-1, BINS)
        filled = (least != EMPTY).any(axis=1)
        low = (densify(least) & np.uint64(0xFF)).astype(np.uint8)
        out += [row.tobytes() if ok else b"" for row, ok in zip(low, filled, strict=True)]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity, 0 to 1; two texts without words are alike, one without is unlike any other."""
    if not a or not b:
        return float(a == b)
    same, chance = np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)), 2.0**-BITS
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges(docs: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """Lower bounds of at most n ranges of doc_id, and the range that each range's greatest doc_id is also sent to."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("k"))
    found = ids.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    rows = sorted((r.lo, r.hi) for r in found.collect())
    guests = {rows[i][1]: i + 1 for i in range(len(rows) - 1)}
    return np.array([lo for lo, _ in rows], np.int64), guests | ({rows[-1][1]: 0} if rows else {})


def fingerprint_neighbours(docs: DataFrame, size: int = SHINGLE, partitions: int | None = None) -> DataFrame:
    """Per document, in descending doc_id: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller doc_id, the first of all after the last. Null text is empty; a
    null doc_id comes last; rows that repeat a doc_id are ordered by text, descending. Other columns are ignored. A
    single document is its own next; an empty table gives no rows.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    bounds, guests = ranges(docs, n)

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, k.to_numpy(), "right") - 1
        also = [guests.get(x) for x in k]
        return pd.Series([[2 * a] if b is None else [2 * a, 2 * b + 1] for a, b in zip(own, also, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def finished(rows: list, last: tuple) -> pa.RecordBatch:
            """Rows of (doc_id, text, fingerprint), each followed by the next; `last` follows the last of them."""
            after = [*rows[1:], last]
            changed = [edited(r[1], x[1]) for r, x in zip(rows, after, strict=True)]
            raw = [c.encode() for c in changed]
            prints = fingerprints(pa.array(raw, pa.binary()), size)
            columns = [
                [r[0] for r in rows],
                [len(r[1]) for r in rows],
                [hashlib.sha256(c).hexdigest() for c in raw],
                [r[2].hex() for r in rows],
                [p.hex() for p in prints],
                [likeness(r[2], p) for r, p in zip(rows, prints, strict=True)],
                [likeness(r[2], x[2]) for r, x in zip(rows, after, strict=True)],
            ]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        held, done = [], False
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                rows = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), fingerprints(part.column(2), size), strict=True))
                for guest, row in zip(part.column(0).to_pylist(), rows, strict=True):
                    if not done:
                        held.append(row)
                        done = guest
                if not done and len(held) > 1:
                    yield finished(held[:-1], held[-1])
                    held = held[-1:]
                elif done and len(held) > 1:
                    yield finished(held[:-1], held[-1])
                    held = []

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = keyed.withColumn("k", F.coalesce("doc_id", F.lit(LEAST_ID)))
    dealt = keyed.select("k", "doc_id", "text", F.explode(places("k")).alias("place"))
    dealt = dealt.select("k", "doc_id", "text", (F.col("place") % 2 == 1).alias("guest"), F.floor(F.col("place") / 2).cast("int").alias("range"))
    ordered = dealt.repartitionById(max(1, len(bounds)), "range").sortWithinPartitions("guest", F.desc("k"), F.desc("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("guest", "doc_id", "text").mapInArrow(lean(run), schema)
