"""Token ids as flat binary files: unsigned ids, 64-bit document offsets, memory-mapped on reading.

Documents are range-partitioned and sorted by doc_id, so part k holds the k-th range. Each part is three files:
  part-NNNNN.ids      unsigned little-endian ids, 16-bit where the vocabulary allows, else 32-bit
  part-NNNNN.offsets  n + 1 64-bit counts: where each document starts within the part
  part-NNNNN.docs     n 64-bit doc_ids, then n bytes that are 1 where the doc_id is null
A part is written under a name of its attempt and renamed when whole, so a retried task leaves the same files. What a
part's ids start at in the corpus is the prefix sum of the parts before it; only one row per part reaches the driver.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import pretokens
from tallyglass.llm.common import lean, scratch, text_of

END_ID = 2


def filesystem(uri: str):
    """The file system and path of a URI or plain path in a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def read_array(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped from a file system that is mounted, else read whole."""
    from pyarrow import fs

    system, path = filesystem(uri)
    if system.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.readall(), dtype)


def id_type(tokenizer_json: str, end_id: int) -> str:
    return "<u2" if max(pretokens.load(tokenizer_json).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encode every document in ascending doc_id order, append `end_id`, write the files; returns the folder.

    Null text is empty and gives `end_id` alone. Null doc_ids come first; rows that repeat a doc_id are ordered by text
    and all written. Other columns are ignored. An empty table writes a manifest with no parts.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    with open(tokenizer, encoding="utf-8") as f:
        tokenizer_json = f.read()
    dtype = id_type(tokenizer_json, end_id)
    tok = spark.sparkContext.broadcast(tokenizer_json)
    system, folder = filesystem(path)
    system.create_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = pretokens.packed_ids(tok.value, dtype), TaskContext.get().partitionId()
        end = np.array([end_id], dtype).tobytes()
        system, folder = filesystem(path)
        name, attempt = f"part-{part:05d}", uuid.uuid4().hex
        ids, n, null, sizes = system.open_output_stream(f"{folder}/.{name}.ids.{attempt}"), [], [], [0]
        with ids:
            for batch in batches:
                n.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                null.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                for packed in cache.values(pretokens.texts_of(batch.column(1))):
                    ids.write(packed + end)
                    sizes.append((len(packed) + len(end)) // len(end))
        offsets = np.cumsum(np.array(sizes, "<i8"))
        for kind, content in (("offsets", offsets.tobytes()), ("docs", b"".join(x.tobytes() for x in (*n, *(m.astype("u1") for m in null))))):
            with system.open_output_stream(f"{folder}/.{name}.{kind}.{attempt}") as f:
                f.write(content)
        for kind in ("ids", "offsets", "docs"):
            system.move(f"{folder}/.{name}.{kind}.{attempt}", f"{folder}/{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": part, "docs": len(sizes) - 1, "tokens": int(offsets[-1])}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).repartitionByRange("doc_id")
    written = rows.sortWithinPartitions("doc_id", "text").mapInArrow(lean(write), "part long, docs long, tokens long").collect()
    parts = [{"part": r.part, "docs": r.docs, "tokens": r.tokens} for r in sorted(written, key=lambda r: r.part) if r.docs]
    bases = accumulate((p["tokens"] for p in parts), initial=0)
    manifest = {"dtype": dtype, "end_id": end_id, "parts": [p | {"base": b} for p, b in zip(parts, bases, strict=False)]}
    with system.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32; a task per part."""
    system, folder = filesystem(path)
    with system.open_input_file(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.readall())
    parts, dtype = manifest["parts"], manifest["dtype"]
    listed = spark.sparkContext.broadcast(parts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            part = listed.value[k]
            name, n = f"{path}/part-{part['part']:05d}", part["docs"]
            ids, offsets = read_array(f"{name}.ids", dtype), read_array(f"{name}.offsets", "<i8")
            raw = read_array(f"{name}.docs", "u1")
            doc_ids, null = np.frombuffer(raw[: 8 * n].tobytes(), "<i8"), np.asarray(raw[8 * n :], bool)
            crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4")) for i in range(n)]
            arrays = [pa.array(doc_ids, mask=null), pa.array(part["base"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
