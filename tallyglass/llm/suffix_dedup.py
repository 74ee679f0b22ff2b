"""Exact substring dedup: bytes covered by a string of `LENGTH` bytes that also starts earlier are removed.

Candidate buckets. In every window of LENGTH bytes the least-hashed k-gram (leftmost on ties) is the window's anchor,
a function of the window's bytes alone, so equal windows have equal anchors, at equal offsets, and meet in one bucket,
named by the anchor's hash. Consecutive windows with one anchor occurrence make a run. Runs are counted by bucket
(combined before the shuffle); a run that is alone in its bucket has no repeats, and this is where almost all text ends.
A bucket says where equal windows can be, never that two windows are equal.

Suffix arrays. The bytes of all other runs are fetched and their suffixes sorted by deep-shallow sorting: bucket and
anchor offset first, then three-way multikey quicksort on 8-byte characters down to a shallow depth, then blind tries
for all groups that still share a prefix. The suffixes that start runs are sorted as deep as runs are long; runs equal to
their ends repeat whole. Then the suffixes that start the other runs' windows are sorted LENGTH bytes deep; neighbours in
the array with that common prefix are equal windows. All but the earliest are repeats. Every repeat is found this way.

Hot buckets. A bucket with n runs is dealt out in ceil(n / PART) parts, each window to the part that its bytes name.
Where there is more than one part, the windows are first sorted among those of their task, so of a passage that a third
of all documents share each task sends each window once.

The texts are written once, bucketed by key: fetching bytes and removing them shuffles runs and spans, not texts.
Documents are ordered by doc_id. Matches never cross documents, and every string is judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import textbytes
from tallyglass.llm.common import bucketed, lean, materialize, release, shuffle_partitions, text_of

LENGTH = 100
ANCHOR = 32
#: 8-byte characters sorted by multikey quicksort before blind tries take over.
SHALLOW = 3
#: Bytes whose windows are hashed together; a longer text is cut, windows of a piece reaching into the next.
PIECE = 1 << 18
POSITION = np.uint64((1 << 20) - 1)
#: Runs of a bucket that one part of it holds.
PART = 512
#: Bytes of runs that are sent, and runs that are sorted, together.
SENT = 1 << 22
SORTED = 1 << 14


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of the texts in `data`: text number, first window, windows, anchor hash and the anchor's offset in the first window of each run."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    up, down = textbytes.powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    gram = textbytes.mix((total[k:] - total[:-k]) * down[: n - k + 1])
    least = gram & ~POSITION | np.arange(len(gram), dtype=np.uint64)
    span, width = 1, length - k + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & POSITION).astype(np.int64)
    valid = np.zeros(len(at) + 1, bool)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid[:-1] = text[: len(at)] == text[length - 1 :]
    opens = valid[:-1].copy()
    opens[1:] &= (at[1:] != at[:-1]) | ~valid[:-2]
    closes = valid[:-1].copy()
    closes[:-1] &= (at[1:] != at[:-1]) | ~valid[1:-1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    return text[first], first - offsets[text[first]], last - first + 1, gram[at[first]], at[first] - first


def runs_of(column: pa.Array, length: int = LENGTH, k: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """runs() over a column: row number, first window within the row, windows, anchor hash, anchor offset."""
    for i, _, data, offsets in textbytes.chunks(column, PIECE):
        if len(offsets) > 2 or len(data) <= 2 * PIECE:
            row, *rest = runs(data, offsets, length, k)
            yield row + i, *rest
            continue
        for at in range(0, len(data) - length + 1, PIECE):
            piece = data[at : at + PIECE + length - 1]
            row, first, *rest = runs(piece, np.array([0, len(piece)]), length, k)
            yield row + i, first + at, *rest


# ---- deep-shallow sorting -------------------------------------------------------------------------------------------


def characters(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one big-endian number; bytes beyond the end are 0."""
    n = -(-len(data) // 8)
    padded = np.concatenate([data, np.zeros(8 * n + 8 - len(data), np.uint8)])
    out = np.empty((n, 8), np.uint64)
    for j in range(8):
        out[:, j] = padded[j : j + 8 * n].view(">u8")
    return out.ravel()[: len(data)]


def character(table: np.ndarray, suffixes: np.ndarray, depth: np.ndarray | int, length: int) -> np.ndarray:
    """Each suffix's 8-byte character at its depth; of the last one, only what lies within `length`."""
    beyond = np.maximum(0, 8 - (length - 8 * np.asarray(depth))).astype(np.uint64)
    return table[suffixes + 8 * depth] >> np.uint64(8) * beyond


def _members(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups of places: the first member's number, each member's group, each member's place."""
    first = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    return first, group, np.arange(len(group)) - first[group] + starts[group]


def _ranks(chosen: np.ndarray, first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each member, how many chosen ones of its group come before it."""
    upto = np.cumsum(chosen) - chosen
    return upto - upto[first][group]


def multikey_quicksort(table: np.ndarray, order: np.ndarray, new: np.ndarray, depths: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort each group of `order` by its suffixes' first `depths` characters; returns start and size of the groups equal so far.

    `new` marks the places where a group begins, and is kept up to date. Each round takes every open group, chooses the median
    of three of its characters as pivot, and partitions the group three ways: the smaller and the greater stay at their depth,
    the equal go on to the next character.
    """
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    depth, equal = np.zeros(len(starts), np.int64), []
    while len(starts):
        first, group, place = _members(starts, sizes)
        suffix = order[place]
        c = character(table, suffix, depth[group], length)
        a, b, d = c[first], c[first + sizes // 2], c[first + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), d))[group]
        less, more = c < pivot, c > pivot
        same = ~(less | more)
        n_less, n_same = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(same, first, dtype=np.int64)
        if not same.all():
            to = np.where(less, _ranks(less, first, group), np.where(same, n_less[group] + _ranks(same, first, group), (n_less + n_same)[group] + _ranks(more, first, group)))
            order[starts[group] + to] = suffix
        starts = np.concatenate([starts, starts + n_less, starts + n_less + n_same])
        sizes, depth = np.concatenate([n_less, n_same, sizes - n_less - n_same]), np.concatenate([depth, depth + 1, depth])
        new[starts[sizes > 0]] = True
        done = (sizes > 1) & (depth == depths)
        equal.append((starts[done], sizes[done]))
        left = (sizes > 1) & ~done
        starts, sizes, depth = starts[left], sizes[left], depth[left]
    return tuple(np.concatenate(x) for x in zip(*equal, strict=True)) if equal else (starts, sizes)


def branch(table: np.ndarray, suffix: np.ndarray, lead: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Where each suffix leaves its lead, as a number in lexicographic order of the branches; the lead's own leaf is in the middle.

    Both agree before character `depth`. A branch is named by the length of the common prefix and the first byte after it:
    those that come before the lead, the shortest prefix first; the lead and its equals; those after it, the longest first.
    """
    middle = 256 * (length + 1)
    out = np.full(len(suffix), middle)
    rest = np.arange(len(suffix))
    for d in range(depth, -(-length // 8)):
        c, own = character(table, suffix[rest], d, length), character(table, lead[rest], d, length)
        apart = np.flatnonzero(c != own)
        if len(apart):
            at, c, own = rest[apart], c[apart], own[apart]
            n = min(8, length - 8 * d)
            differ = c ^ own
            common = sum(((differ < np.uint64(1 << 8 * (n - k))).astype(np.int64) for k in range(1, n)), np.zeros(len(at), np.int64))
            byte = (c >> (np.uint64(8) * (n - 1 - common).astype(np.uint64)) & np.uint64(255)).astype(np.int64)
            prefix = 8 * d + common
            out[at] = np.where(c < own, 256 * prefix + byte, middle + 1 + 256 * (length - prefix) + byte)
            rest = np.delete(rest, apart)
    return out


def blind_tries(table: np.ndarray, order: np.ndarray, new: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int, length: int) -> None:
    """Order each group, which shares its first `depth` characters, by a blind trie of its own, all tries at once.

    A trie keeps the depths and first bytes of its branches only. Its spine is the group's first suffix; every other suffix is
    compared with it once and hung on the branch where it leaves. The suffixes on one branch share more than the branch's depth
    and are the next round's group, so there are at most as many rounds as bytes. A leaf is the suffixes equal up to `length`.
    """
    middle = 256 * (length + 1)
    while len(starts):
        first, group, place = _members(starts, sizes)
        suffix = order[place]
        on = branch(table, suffix, suffix[first][group], depth, length)
        mixed = np.flatnonzero(np.logical_or.reduceat(on != middle, first))
        if not len(mixed):
            return
        chosen = np.isin(group, mixed)
        place, suffix, on, group = place[chosen], suffix[chosen], on[chosen], group[chosen]
        by = np.lexsort((on, group))
        suffix, on = suffix[by], on[by]
        order[place] = suffix
        edge = np.ones(len(on), bool)
        edge[1:] = (on[1:] != on[:-1]) | (group[1:] != group[:-1])
        new[place[edge]] = True
        at = np.flatnonzero(edge)
        n = np.diff(np.append(at, len(on)))
        again = (n > 1) & (on[at] != middle)
        starts, sizes = place[at[again]], n[again]


def suffix_groups(data: np.ndarray, suffixes: np.ndarray, length: int = LENGTH, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in lexicographic order of their first `length` bytes, and the number of each one's group of equals.

    group: numbers by which the suffixes are ordered already; only those of one number are sorted among themselves.
    """
    if not len(suffixes):
        return suffixes, suffixes
    order, new = suffixes.copy(), np.zeros(len(suffixes), bool)
    new[0] = True
    if group is not None:
        new[1:] = group[1:] != group[:-1]
    table, depths = characters(data), -(-length // 8)
    shallow = min(SHALLOW, depths)
    starts, sizes = multikey_quicksort(table, order, new, shallow, length)
    if shallow < depths:
        blind_tries(table, order, new, starts, sizes, shallow, length)
    return order, np.cumsum(new) - 1


def repeated(raws: list[bytes], windows: np.ndarray, bucket: np.ndarray, offset: np.ndarray, wanted: np.ndarray | None, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, step and number of windows of each stretch of windows that repeat earlier ones of their bucket, in order of runs.

    raws: the bytes of each run's windows, runs in order of documents. offset: of the anchor in the run's first window.
    wanted: of all windows in order, those that are looked at; the others are not there.

    The suffixes that start runs are sorted first, as deep as the longest run; a run that equals an earlier one to its end
    repeats all of its windows. Then the suffixes that start the windows of the other runs are sorted.
    """
    rows, gone = np.arange(len(raws)), np.zeros(len(raws), bool)
    if wanted is None:
        width = -(-max(map(len, raws)) // 8) * 8
        known = (bucket * (length + 1) + offset) * (length + 1) + windows
        by = np.argsort(known, kind="stable")
        order, group = suffix_groups(np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raws]), np.uint8), by * width, width, known[by])
        order //= width
        gone[order] = order != np.minimum.reduceat(order, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))[group]
        rows = np.flatnonzero(~gone)
    data, base = np.frombuffer(b"".join([raws[i] for i in rows.tolist()]), np.uint8), np.concatenate([[0], np.cumsum(windows[rows] + length - 1)])
    run = np.repeat(np.arange(len(rows)), windows[rows])
    step = np.arange(len(run)) - np.repeat(np.cumsum(windows[rows]) - windows[rows], windows[rows])
    if wanted is not None:
        run, step = run[wanted], step[wanted]
    known = bucket[rows][run] * (length + 1) + offset[rows][run] - step
    by = np.argsort(known, kind="stable")
    order, group = suffix_groups(data, (base[run] + step)[by], length, known[by])
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(order) else order
    again = np.sort(order[order != np.minimum.reduceat(order, starts)[group]]) if len(order) else order
    run = np.searchsorted(base, again, "right") - 1
    step = again - base[run]
    at = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (step[1:] != step[:-1] + 1)])) if len(run) else run
    whole = np.flatnonzero(gone)
    run = np.concatenate([rows[run[at]], whole])
    step, n = np.concatenate([step[at], np.zeros(len(whole), np.int64)]), np.concatenate([np.diff(np.append(at, len(again))), windows[whole]])
    by = np.lexsort((step, run))
    return run[by], step[by], n[by]


def window_parts(raws: list[bytes], windows: np.ndarray, parts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The part of its bucket that each window's bytes name."""
    data, base = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    run = np.repeat(np.arange(len(raws)), windows)
    at = base[run] + np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    up, down = textbytes.powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return (textbytes.mix((total[at + length] - total[at]) * down[at]) % parts[run].astype(np.uint64)).astype(np.int64)


# ---- Spark ----------------------------------------------------------------------------------------------------------


def spans(first: np.ndarray, windows: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the windows: starts and ends."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + windows + length - 1, -1)
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    return np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])


def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, raw: a key that is unique and orders documents; doc_id itself where it is unique and never null.

    Otherwise documents are ordered by doc_id (null first), then text, and numbered in that order.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("raw"))
    repeated = rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "raw")
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "raw").sortWithinPartitions("doc_id", "raw")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "raw"), "suffix-keyed")


RUN = "bucket long, key long, first int, windows int, offset int"
#: raw: the bytes of a run's windows; null where the windows are repeats already. wanted: bits of the windows to look at, all where null.
SEND = "bucket long, part int, key long, first int, windows int, offset int, raw binary, wanted binary"
REPEAT = "key long, first int, windows int"
DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _table(schema: str, **columns) -> pa.RecordBatch:
    """A batch of `schema`'s columns; those not given are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[name], kinds[t]) if name in columns else pa.nulls(n, kinds[t]) for name, t in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a column of arrays of structs: how many elements each row has, and the fields of all elements."""
    flat = column.flatten()
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), {f.name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(flat.type)}


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining UTF-8 bytes).

    Null text is empty. A text shorter than `length` loses nothing. Rows that repeat a doc_id come in the order of
    their texts, null doc_ids first; of equal rows all but one lose every repeated byte. Other columns are ignored. An
    empty table gives no rows.
    """
    anchor = min(anchor, length)
    spark = docs.sparkSession
    n, part_size = shuffle_partitions(spark), PART
    source = keyed(docs)

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, ...] | None:
        every = list(runs_of(batch.column(1), length, anchor))
        return tuple(np.concatenate(x) for x in zip(*every, strict=True)) if every else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (runs_ := found(batch)) is not None and len(runs_[0]):
                bucket, times = np.unique(runs_[3], return_counts=True)
                yield _table("bucket long, n long", bucket=bucket.view(np.int64), n=times)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (runs_ := found(batch)) is not None and len(runs_[0]):
                row, first, windows, bucket, offset = runs_
                yield _table(RUN, bucket=bucket.view(np.int64), key=batch.column(0).to_numpy()[row], first=first, windows=windows, offset=offset)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the runs that are to be sorted, to the parts of their buckets."""

        def cold(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            bucket, key, first, windows, offset, _, raw = zip(*rows, strict=True)
            yield _table(SEND, bucket=bucket, part=[0] * len(rows), key=key, first=first, windows=windows, offset=offset, raw=raw)

        def hot(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Sorted here first: what repeats an earlier window is settled, the rest is dealt out by its bytes."""
            rows.sort(key=lambda r: r[:3])
            raws = [r[6] for r in rows]
            bucket, key, first, windows, offset, parts = np.array([r[:6] for r in rows], np.int64).T
            _, near = np.unique(bucket, return_inverse=True)
            run, step, n = repeated(raws, windows, near, offset, None, length)
            if len(run):
                spread = textbytes.mix(key[run].view(np.uint64)).view(np.int64)
                yield _table(SEND, bucket=spread, part=np.zeros(len(run), np.int64), key=key[run], first=first[run] + step, windows=n)
            base = np.cumsum(windows) - windows
            edge = np.zeros(windows.sum() + 1, np.int64)
            np.add.at(edge, base[run] + step, 1)
            np.add.at(edge, base[run] + step + n, -1)
            open_ = np.cumsum(edge[:-1]) == 0
            part = np.where(open_, window_parts(raws, windows, parts, length), -1)
            out = []
            for i in range(len(rows)):
                own = part[base[i] : base[i] + windows[i]]
                for p in np.unique(own[own >= 0]).tolist():
                    out.append((*rows[i][:1], p, *rows[i][1:5], raws[i], np.packbits(own == p).tobytes()))
            if out:
                yield _table(SEND, **dict(zip((x.split()[0] for x in SEND.split(", ")), zip(*out, strict=True), strict=True)))

        held: dict[bool, list] = {True: [], False: []}
        size = 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                piece = batch.slice(at, 256)
                counts, marks = _lists(piece.column(2))
                ends = np.cumsum(counts)
                for key, raw, lo, hi in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    for bucket, first, windows, offset, parts in zip(*(marks[c][lo:hi].tolist() for c in ("bucket", "first", "windows", "offset", "parts")), strict=True):
                        held[parts > 1].append((bucket, key, first, windows, offset, parts, raw[first : first + windows + length - 1]))
                        size += windows + length
                        if size > SENT:
                            for which, put in ((True, hot), (False, cold)):
                                if held[which]:
                                    yield from put(held[which])
                                    held[which] = []
                            size = 0
        for which, put in ((True, hot), (False, cold)):
            if held[which]:
                yield from put(held[which])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs in order of bucket, part, key and first window: the windows that repeat an earlier one."""

        def repeats(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            bucket, part, key, first, windows = (table.column(i).to_numpy().astype(np.int64) for i in range(5))
            bare = table.column("raw").is_null().to_numpy()
            if bare.any():
                yield _table(REPEAT, key=key[bare], first=first[bare], windows=windows[bare])
            if bare.all():
                return
            sent = ~bare
            offset = table.column("offset").to_numpy(zero_copy_only=False)[sent].astype(np.int64)
            bucket, part, key, first, windows = (x[sent] for x in (bucket, part, key, first, windows))
            raws, bits = table.column("raw").filter(pa.array(sent)).to_pylist(), table.column("wanted").filter(pa.array(sent))
            wanted = None
            if bits.null_count < len(bits):
                own = [np.ones(w, bool) if b is None else np.unpackbits(np.frombuffer(b, np.uint8), count=w).astype(bool) for b, w in zip(bits.to_pylist(), windows.tolist(), strict=True)]
                wanted = np.concatenate(own)
            near = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]))
            run, step, n = repeated(raws, windows, near, offset, wanted, length)
            if len(run):
                yield _table(REPEAT, key=key[run], first=first[run] + step, windows=n)

        held: list[pa.RecordBatch] = []
        last = None
        for batch in (b.slice(at, SORTED) for b in batches for at in range(0, len(b), SORTED)):
            bucket, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and (bucket[0], part[0]) != last:
                yield from repeats(held)
                held = []
            last = (bucket[-1], part[-1])
            other = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            at = int(other[-1]) + 1 if len(other) else 0  # where the last part begins; it may go on in the next batch
            if at:
                yield from repeats([*held, batch.slice(0, at)])
                held = []
            held.append(batch.slice(at))
        if held:
            yield from repeats(held)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                piece = batch.slice(at, 256)
                counts, gone = _lists(piece.column(2))
                ends, out = np.cumsum(counts), []
                for doc_id, raw, lo, hi in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    starts, stops = spans(gone["first"][lo:hi], gone["windows"][lo:hi], length, len(raw))
                    kept, upto = hashlib.sha256(), 0
                    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                        kept.update(raw[upto:a])
                        upto = b
                    kept.update(raw[upto:])
                    out.append((doc_id, len(raw), int((stops - starts).sum()), len(starts), kept.hexdigest()))
                yield _table(DONE, **dict(zip((x.split()[0] for x in DONE.split(", ")), zip(*out, strict=True), strict=True)))

    texts = source.select("key", "raw")
    shared = texts.mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    # Written, so that both sides of the join are plain exchanges, which adaptive execution splits where a bucket is hot.
    shared = materialize(shared.select(F.col("bucket").alias("of"), F.ceil(F.col("n") / part_size).cast("int").alias("parts")), "suffix-shared")
    marks = texts.mapInArrow(lean(find), RUN).join(shared.hint("shuffle_hash"), F.col("bucket") == F.col("of")).select("key", "bucket", "first", "windows", "offset", "parts")
    marks = materialize(marks, "suffix-marks")
    release(spark)
    whole = bucketed(source, "suffix-texts", "key", n)
    release(spark)
    listed = marks.groupBy("key").agg(F.collect_list(F.struct("bucket", "first", "windows", "offset", "parts")).alias("marks"))
    fetched = whole.join(listed.withColumnRenamed("key", "of").hint("shuffle_hash"), F.col("key") == F.col("of")).select("key", "raw", "marks")
    dealt = fetched.mapInArrow(lean(send), SEND).repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "key", "first")
    again = materialize(dealt.mapInArrow(lean(sort), REPEAT), "suffix-repeats")
    release(spark)
    gone = again.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("first", "windows")).alias("gone")).hint("shuffle_hash")
    return whole.join(gone, F.col("key") == F.col("of"), "left").select("doc_id", "raw", "gone").mapInArrow(lean(remove), DONE)
