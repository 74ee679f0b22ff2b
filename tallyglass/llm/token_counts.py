"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the corpus's frequent pre-tokens with their token counts, bounded to `table_entries`
and broadcast. Tier two is each worker's cache: a pre-token the table lacks is encoded once by the tokenizer and
remembered. Pre-tokens are never shuffled: the table comes from one bounded summary per task over all documents,
merged in a tree. Which pre-tokens the table holds changes speed only, never a count.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import pretokens
from tallyglass.llm.common import lean, text_of

#: Pre-tokens in the broadcast table and in each task's summary; none is longer than pretokens.LONGEST, so a table is 2 MB at most.
TABLE_ENTRIES = 16_384
#: Pre-tokens a task counts at once; beyond it the rarer ones are let go (a lossy count).
COUNTED_ENTRIES = 200_000


def _cut(counts: Counter, n: int) -> Counter:
    return Counter(dict(counts.most_common(n))) if len(counts) > n else counts


def _packed(counts: Counter, n: int) -> bytes:
    counts = Counter({w: c for w, c in counts.items() if len(w) <= pretokens.LONGEST})
    return zlib.compress(pickle.dumps(dict(_cut(counts, n))), 1)


def frequent_pretokens(docs: DataFrame, tokenizer_json: str, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """About the most frequent pre-tokens of all documents, with their token counts; at most `entries`."""
    if not entries:
        return {}
    tok = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = pretokens.lengths(tok.value, {}), Counter()
        for batch in batches:
            for text in pretokens.texts_of(batch.column(0)):
                counts.update(cache.words(text) or ())
                if len(counts) > COUNTED_ENTRIES:
                    counts = _cut(counts, COUNTED_ENTRIES // 4)
        yield pa.RecordBatch.from_arrays([pa.array([_packed(counts, entries)], pa.binary())], ["summary"])

    def merge(a: bytes, b: bytes) -> bytes:
        both = Counter(pickle.loads(zlib.decompress(a)))
        both.update(pickle.loads(zlib.decompress(b)))
        return _packed(both, entries)

    summaries = docs.select(text_of().alias("text")).mapInArrow(lean(summarise), "summary binary").rdd.map(lambda r: bytes(r[0]))
    if summaries.getNumPartitions() == 0:
        return {}
    merged = summaries.treeAggregate(_packed(Counter(), entries), merge, merge, depth=3)
    words = sorted(pickle.loads(zlib.decompress(merged)))
    return dict(zip(words, map(pretokens.PretokenCache(tokenizer_json, len, sum).encode_word, words), strict=True))


def token_counts(docs: DataFrame, tokenizer: str, limit: int, table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    `tokenizer` is the path of a tokenizers .json on the driver. Null text is empty: 0 bytes, 0 tokens. Special strings
    inside a text count as the library's default has them. Repeated rows are counted each; other columns are ignored.
    """
    with open(tokenizer, encoding="utf-8") as f:
        tokenizer_json = f.read()
    context = docs.sparkSession.sparkContext
    table = context.broadcast(frequent_pretokens(docs, tokenizer_json, table_entries))
    tok = context.broadcast(tokenizer_json)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = pretokens.lengths(tok.value, table.value)
        for batch in batches:
            n = pa.array(cache.values(pretokens.texts_of(batch.column(2))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    counted = rows.mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
