"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint. Distinct fingerprints are laid into tiles by the population counts of their four
16-bit quarters; two fingerprints within Hamming distance r have quarter counts that differ by r in total at most, so
a tile is compared only with the tiles in that range and all other tile pairs are skipped. Tiles are compared whole,
by exclusive-or and bit counts in numpy, and each comparison task returns a spanning forest of the links it found
instead of every pair. Components of the links give the groups.

The comparison is exact, so its work grows with the square of the number of distinct fingerprints (about 5 % of all
pairs are compared); exact copies are compared once.

A radius of 3 in 64 bits finds texts that are all but equal. For a stated similarity a fingerprint needs more bits: with
`WIDE_WORDS` words of 64 bits, texts whose distinct five-word shingles have a Jaccard similarity of 0.8 differ in 38.8 +-
5.7 of 256 bits (48 +- 6.2 at the worst, four shingles against five), unrelated texts in 128 +- 8. Such fingerprints are
laid into tiles by total population count, and those within `REACH` bits, `EARLY` of them in the first 128, are only
candidates. A link is what the exact Jaccard similarity of the distinct shingles confirms: candidates are grouped by
component, each component's texts are dealt into blocks, and each pair of blocks is confirmed by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import textbytes
from tallyglass.llm.common import fresh, lean, located, materialize, shuffle_partitions, text_of, without
from tallyglass.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprint pairs compared in one numpy call: what fits a core's cache.
BLOCK = 1 << 17
#: Words and shingle size for a similarity of 0.8 on five-word shingles; WIDE_RADIUS is a plain radius without confirmation.
WIDE_WORDS = 4
WIDE_RADIUS = 52
WIDE_SHINGLE = 5
#: Candidates differ in REACH of all bits and in EARLY of the first two words at most; links have this similarity at least.
REACH = 72
EARLY = 40
SIMILAR = (4, 5)
#: Texts of a candidate component that are confirmed together.
MEMBERS = 128
#: Members of candidate components that are broadcast to their texts at most (about 100 bytes each); beyond, the texts are shuffled.
MEMBERS_BROADCAST = 100_000
#: Fingerprints in a tile or block, and blocks that one task compares with a block.
TILE = 8192
SLICE = 16
#: Shingles whose bits are counted together.
BATCH = 1 << 17
LANES = np.uint64(0x0001000100010001)


def _text_hashes(raw: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, [joined[a:b] for a, b in pairs], repeat(seed))), ">u8")


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each run of hashes; runs have at most 65,535."""
    out = np.empty((len(starts), 64), np.int64)
    for s in range(16):
        sums = np.add.reduceat(hashes >> np.uint64(s) & LANES, starts)
        out[:, s::16] = sums.view("<u2").reshape(-1, 4)
    return out


def fingerprints_of(texts: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 where over half of its shingle hashes have it; 0 without words."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    for i, raw in enumerate(texts):
        hashes = _text_hashes(raw, size, seed)
        for at in range(0, len(hashes), 65_535):
            held.append(hashes[at : at + 65_535])
            owners.append(i)
        if held and (sum(map(len, held[-64:])) > BATCH or len(held) > 1024 or i == len(texts) - 1):
            _set_bits(out, held, owners)
            held, owners = [], []
    if held:
        _set_bits(out, held, owners)
    return out


def _set_bits(out: np.ndarray, held: list[np.ndarray], owners: list[int]) -> None:
    """All runs of a text arrive together, since texts are flushed whole."""
    lengths = np.array([len(h) for h in held])
    counts = bit_counts(np.concatenate(held).astype("<u8"), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    owner, first = np.unique(owners, return_index=True)
    set_bits = 2 * np.add.reduceat(counts, first) > np.add.reduceat(lengths, first)[:, None]
    out[owner] = np.bitwise_or.reduce(set_bits.astype(np.uint64) << np.arange(64, dtype=np.uint64), axis=1)


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1).to_pylist(), size, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("raw"))
    return rows.mapInArrow(lean(run), "doc_id long, fp long")


def tile_of(fp: np.ndarray) -> np.ndarray:
    """The tile number: population counts of the four 16-bit quarters, in base 17."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int64) @ 17 ** np.arange(4)


def half_range(radius: int) -> np.ndarray:
    """Count differences in reach, one of each opposite pair; the first is the tile itself."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return np.array(sorted((d for d in steps if d >= (0, 0, 0, 0)), key=lambda d: (any(d), d)))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Runs of rows with one key in the first column: key, second column, third column."""
    key, second, third = None, [], []
    for batch in batches:
        for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if k != key and second:
                yield key, second, third
                second, third = [], []
            key = k
            second.append(a)
            third.append(b)
    if second:
        yield key, second, third


def _link(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of each i and j; parents are roots before and after."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def forest(own: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links from `own` to `own` and to `others`."""
    everything = np.concatenate([own, others])
    parent = np.arange(len(everything))
    rows = max(1, BLOCK // max(1, len(everything)))
    for at in range(0, len(own), rows):
        rest = everything[at:]
        near = np.flatnonzero((np.bitwise_count(own[at : at + rows, None] ^ rest[None, :]) <= radius).ravel())
        i, j = np.divmod(near, len(rest))
        apart = i != j
        if apart.any():
            _link(parent, i[apart] + at, j[apart] + at)
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return everything[child], everything[parent[child]]


def neighbours(tile: int, reach: np.ndarray) -> list[int]:
    """The tile itself, then the other tiles at the count differences `reach`."""
    to = np.array([tile // 17**k % 17 for k in range(4)]) + reach
    return (to[((to >= 0) & (to <= 16)).all(axis=1)] @ 17 ** np.arange(4)).tolist()


def links(fps: DataFrame, radius: int = RADIUS, block: int = TILE) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp) that connect all pairs within `radius` differing bits.

    A tile is dealt into blocks of about `block` fingerprints by hash. A block is compared with itself, with half of the other
    blocks of its tile, and is sent to every block of the tiles in reach; what comes to a block is split by the sender's number
    into slices of SLICE blocks a tile, each with a copy of the block, so no task's share grows with its tile. The counts by
    tile that the driver holds are 17 ** 4 at most.
    """
    reach, n = half_range(radius), shuffle_partitions(fps.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(tile_of(np.ascontiguousarray(fp))), batch.column(0)], ["tile", "fp"])

    tiled = fps.select("fp").mapInArrow(lean(number), "tile long, fp long")
    parts = {r.tile: -(-r.n // block) for r in tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([parts[t] for t in batch.column(0).to_pylist()], np.uint64)
            part = (textbytes.mix(batch.column(1).to_numpy().view(np.uint64)) % np.maximum(of, 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy() << 40 | part), batch.column(1)], ["block", "fp"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(block: int, values: list) -> pa.RecordBatch:
            tile, part = block >> 40, block & (1 << 40) - 1
            m, near = parts[tile], neighbours(tile, reach)
            senders = neighbours(tile, -reach)  # the tile itself and those that send to it
            slices = -(-max(parts.get(t, 0) for t in senders) // SLICE)
            to = [(tile, part, s, True) for s in range(slices)]
            to += [(tile, (part - k) % m, part // SLICE, False) for k in range(1, m // 2 + 1) if not (2 * k == m and part < m // 2)]
            to += [(t, p, part // SLICE, False) for t in near[1:] for p in range(parts.get(t, 0))]
            blob = np.array(values, np.int64).tobytes()
            names = ("tile", "part", "slice", "own")
            columns = [pa.array(c, k) for c, k in zip(zip(*to, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([blob] * len(to), pa.binary())], [*names, "fps"])

        key, held = None, []
        for batch in batches:
            for at, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and at != key:
                    yield sent(key, held)
                    held = []
                key = at
                held.append(fp)
        if held:
            yield sent(key, held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for at in range(0, len(batch), 64) for r in batch.slice(at, 64).to_pylist())
        for _, group in groupby(rows, key=lambda r: (r["tile"], r["part"], r["slice"])):
            sets = {True: [], False: []}
            for r in group:
                sets[r["own"]].append(np.frombuffer(r["fps"], np.uint64))
            if not sets[True]:  # a block that the hash left empty
                continue
            a, b = forest(np.concatenate(sets[True]), np.concatenate([np.zeros(0, np.uint64), *sets[False]]), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    placed = tiled.mapInArrow(lean(place), "block long, fp long").repartition(n, "block").sortWithinPartitions("block")
    dealt = placed.mapInArrow(lean(deal), "tile long, part long, slice long, own boolean, fps binary")
    dealt = dealt.repartition(n, "tile", "part", "slice").sortWithinPartitions("tile", "part", "slice")
    return dealt.mapInArrow(lean(compare), "a long, b long")


# ---- wide fingerprints ----------------------------------------------------------------------------------------------


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's hashes once, by owner and hash."""
    by = np.lexsort((h, owner))
    h, owner = h[by], owner[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def wide_fingerprints_of(texts: pa.Array, size: int = WIDE_SHINGLE, width: int = WIDE_WORDS) -> np.ndarray:
    """Rows of `width` words: bit k of a word is 1 where over half of the distinct shingles' hashes for that word have it."""
    out = np.zeros((len(texts), width), np.uint64)
    for i, j, data, offsets in textbytes.chunks(texts, rows=1024):
        h, owner = textbytes.shingle_hashes(textbytes.LOWER[data], offsets, size)
        h, owner = distinct(h, owner)
        total = np.bincount(owner, minlength=j - i)
        starts = np.concatenate([np.arange(a, b, 65_535) for a, b in zip(np.cumsum(total) - total, np.cumsum(total), strict=True) if b > a] or [np.zeros(0, np.int64)])
        if not len(starts):
            continue
        text, first = np.unique(owner[starts], return_index=True)
        for w in range(width):
            word = textbytes.mix(h ^ np.uint64((0x9E3779B97F4A7C15 * (w + 1)) & 0xFFFFFFFFFFFFFFFF))
            set_bits = 2 * np.add.reduceat(bit_counts(word, starts), first) > total[text][:, None]
            out[i + text, w] = np.bitwise_or.reduce(set_bits.astype(np.uint64) << np.arange(64, dtype=np.uint64), axis=1)
    return out


def wide_fingerprints(docs: DataFrame, size: int = WIDE_SHINGLE, width: int = WIDE_WORDS) -> DataFrame:
    """doc_id, fp (8 * width bytes), text_hash of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [row.tobytes() for row in wide_fingerprints_of(batch.column(1), size, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary()), batch.column(2)], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    return rows.mapInArrow(lean(run), "doc_id long, fp binary, text_hash long")


def tile_plan(counts: dict[int, int], tile: int = TILE) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """For each population count its first tile and number of tiles; for each tile its least and greatest count."""
    place, limits, held = {}, [], 0
    for pop in sorted(counts):
        if limits and held + counts[pop] <= tile:
            place[pop] = (len(limits) - 1, 1)
            limits[-1] = (limits[-1][0], pop)
            held += counts[pop]
        else:
            parts = -(-counts[pop] // tile)
            place[pop] = (len(limits), parts)
            limits += [(pop, pop)] * parts
            held = counts[pop] if parts == 1 else tile
    return place, limits


def partners(tile: int, limits: list[tuple[int, int]], radius: int) -> list[int]:
    """The tiles to whose task this one is sent: itself and half of the others, each pair once, within the radius."""
    n = len(limits)
    lo, hi = limits[tile]
    to = [(tile - k) % n for k in range(n // 2 + 1) if not (2 * k == n and tile < n // 2)]
    return [t for t in to if limits[t][0] - hi <= radius and lo - limits[t][1] <= radius]


def wide_near(own: np.ndarray, others: np.ndarray, radius: int, early: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, block by block; later words are compared only where the first two are within `early`."""
    early = radius if early is None else early
    rows = max(1, BLOCK // max(1, len(others)))
    first = [np.ascontiguousarray(others[:, w]) for w in range(min(2, others.shape[1]))]
    for at in range(0, len(own), rows):
        part = own[at : at + rows]
        apart = sum(np.bitwise_count(part[:, w, None] ^ column[None, :]) for w, column in enumerate(first))
        near = np.flatnonzero((apart <= min(radius, early)).ravel())
        i, j = np.divmod(near, len(others))
        apart = apart.ravel()[near].astype(np.int64)
        for w in range(2, part.shape[1]):
            apart += np.bitwise_count(part[i, w] ^ others[j, w])
            near = apart <= radius
            i, j, apart = i[near], j[near], apart[near]
        if len(i):
            yield i + at, j


def wide_links(fps: DataFrame, radius: int = WIDE_RADIUS, tile: int = TILE, early: int | None = None) -> DataFrame:
    """a, b: links among nodes (node long, fp binary) that connect all pairs within `radius` differing bits, `early` of them in the first two words."""
    n = shuffle_partitions(fps.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pop = [np.bitwise_count(np.frombuffer(fp, np.uint64)).sum() for fp in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pop, pa.int64())], ["node", "fp", "pop"])

    counted = fps.select("node", "fp").mapInArrow(lean(count), "node long, fp binary, pop long")
    place, limits = tile_plan({r.pop: r.n for r in counted.groupBy("pop").agg(F.count(F.lit(1)).alias("n")).collect()}, tile)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [place[p] for p in batch.column(2).to_pylist()]
            own = [first + node % parts for (first, parts), node in zip(at, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), batch.column(0), batch.column(1)], ["tile", "node", "fp"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, nodes, prints in _grouped(batches):
            to = [(own, s, True) for s in range(len(limits) // 2 // SLICE + 1)]
            to += [(t, (own - t) % len(limits) // SLICE, False) for t in partners(own, limits, radius) if t != own]
            packed_nodes, packed_prints = np.array(nodes, np.int64).tobytes(), b"".join(prints)
            columns = (*zip(*to, strict=True), [packed_nodes] * len(to), [packed_prints] * len(to))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tile", "slice", "own", "nodes", "fps"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for row in (r for batch in batches for at in range(0, len(batch), 4) for r in batch.slice(at, 4).to_pylist()):
            nodes = np.frombuffer(row["nodes"], np.int64)
            prints = np.frombuffer(row["fps"], np.uint64).reshape(len(nodes), -1)
            if row["own"]:
                here = ((row["tile"], row["slice"]), nodes, prints)
                if row["slice"]:  # compared with itself in the first slice
                    continue
            if here is None or here[0] != (row["tile"], row["slice"]):  # a tile that the hash left empty
                continue
            _, own_nodes, own_prints = here
            both = own_nodes if row["own"] else np.concatenate([own_nodes, nodes])
            parent, shift = np.arange(len(both)), 0 if row["own"] else len(own_nodes)
            for i, j in wide_near(own_prints, prints, radius, early):
                _link(parent, i, j + shift)
            child = np.flatnonzero(parent != np.arange(len(parent)))
            yield pa.RecordBatch.from_arrays([pa.array(both[child]), pa.array(both[parent[child]])], ["a", "b"])

    tiled = counted.mapInArrow(lean(number), "tile long, node long, fp binary").repartition(n, "tile").sortWithinPartitions("tile")
    dealt = tiled.mapInArrow(lean(deal), "tile long, slice long, own boolean, nodes binary, fps binary")
    dealt = dealt.repartition(n, "tile", "slice").sortWithinPartitions("tile", "slice", F.desc("own"))
    return dealt.mapInArrow(lean(compare), "a long, b long")


def shingle_sets(texts: pa.Array, size: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each text has, and all their hashes in order of texts; a text without words has one of its own."""
    sizes, held = np.zeros(len(texts), np.int64), []
    for i, j, data, offsets in textbytes.chunks(texts, rows=1024):
        h, owner = textbytes.shingle_hashes(textbytes.LOWER[data], offsets, size)
        bare = np.setdiff1d(np.arange(j - i), owner)
        h, owner = distinct(np.concatenate([h, np.zeros(len(bare), np.uint64)]), np.concatenate([owner, bare]))
        sizes[i:j] = np.bincount(owner, minlength=j - i)
        held.append(h)
    return sizes, np.concatenate(held) if held else np.zeros(0, np.uint64)


def similar_pairs(own: tuple, others: tuple | None, radius: int, early: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links from the texts of `own` to each other, or to `others`, as nodes.

    Both are (nodes, fingerprints, set sizes, hashes of all sets). Only pairs within reach that no link connects yet are counted.
    """
    nodes, prints, sizes, hashes = others or own
    shift = len(own[0]) if others else 0
    both = np.concatenate([own[0], nodes]) if others else nodes
    _, ids = np.unique(np.concatenate([own[3], hashes]), return_inverse=True)
    mine, ids = ids[: len(own[3])], ids[len(own[3]) :]
    to, at = np.concatenate([[0], np.cumsum(own[2])]), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    parent, mark = np.arange(len(both)), np.zeros(len(own[3]) + len(hashes), bool)
    for rows, columns in wide_near(own[1], prints, radius, early):
        for i in np.unique(rows):
            j = columns[rows == i]
            j = j[parent[j + shift] != parent[i]]
            if not len(j):
                continue
            mark[mine[to[i] : to[i + 1]]] = True
            shared = np.add.reduceat(mark[ids].astype(np.int64), at)[j]
            mark[mine[to[i] : to[i + 1]]] = False
            j = j[SIMILAR[1] * shared >= SIMILAR[0] * (own[2][i] + sizes[j] - shared)]
            if len(j):
                _link(parent, np.full(len(j), i), j + shift)
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return both[child], both[parent[child]]


def confirmed(docs: DataFrame, fps: DataFrame, groups: DataFrame, size: int, radius: int, early: int) -> DataFrame:
    """a, b: links that connect all pairs within reach whose sets of shingles are SIMILAR.

    fps: node, fp, text_hash. groups: node, root of the candidates' components, whose texts alone are fetched from docs.
    """
    n = shuffle_partitions(docs.sparkSession)
    blocks = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("long").alias("blocks"))
    members = fps.join(groups.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node")).join(blocks, "root")
    members = materialize(members.select("node", "fp", "text_hash", "root", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")), "wide-members")
    few = members.count() <= MEMBERS_BROADCAST
    texts = docs.select(text_of().alias("text")).withColumn("text_hash", F.xxhash64("text")).join(members.hint("broadcast" if few else "shuffle_hash"), "text_hash")
    texts = texts.groupBy("root", "block", "blocks", "node", "fp").agg(F.first("text").alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for at in range(0, len(batch), 256) for r in batch.slice(at, 256).to_pylist())
        for (root, block), group in groupby(rows, key=lambda r: (r["root"], r["block"])):
            group = list(group)
            m = group[0]["blocks"]
            to = [(block - k) % m for k in range(m // 2 + 1) if not (2 * k == m and block < m // 2)]
            sizes, hashes = shingle_sets(pa.array([r["text"] for r in group], pa.large_string()), size)
            packed = (np.array([r["node"] for r in group], np.int64).tobytes(), b"".join(r["fp"] for r in group), sizes.tobytes(), hashes.tobytes())
            columns = ([root] * len(to), to, [t == block for t in to], *([p] * len(to) for p in packed))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["root", "block", "own", "nodes", "fps", "sizes", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, here = None, None
        for row in (r for batch in batches for at in range(0, len(batch), 4) for r in batch.slice(at, 4).to_pylist()):
            nodes = np.frombuffer(row["nodes"], np.int64)
            sets = (nodes, np.frombuffer(row["fps"], np.uint64).reshape(len(nodes), -1), np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["hashes"], np.uint64))
            if row["own"]:
                key, here = (row["root"], row["block"]), sets
            elif key != (row["root"], row["block"]):  # a block that the hash left empty has nothing to confirm
                continue
            a, b = similar_pairs(here, None if row["own"] else sets, radius, early)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = texts.repartition(n, "root", "block").sortWithinPartitions("root", "block")
    dealt = dealt.mapInArrow(lean(deal), "root long, block long, own boolean, nodes binary, fps binary, sizes binary, hashes binary")
    dealt = dealt.repartition(n, "root", "block").sortWithinPartitions("root", "block", F.desc("own"))
    return dealt.mapInArrow(lean(compare), "a long, b long")


def _named(rows: DataFrame, links_of, name: str, by: tuple[str, ...] = ("fp",)) -> DataFrame:
    """doc_id, fp, component_id from fingerprinted rows; links_of(distinct values of `by` with node and least) gives the links."""
    fps = materialize(rows.groupBy(*by).agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), f"{name}-distinct")
    rooted = fps.join(components(links_of(fps)).withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    rooted = rooted.select(*by, "least", F.coalesce("root", "node").alias("root"))
    groups = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), f"{name}-groups")
    named = materialize(rooted.join(groups, "root").select(*by, "component_id"), f"{name}-named")
    return rows.join(named, list(by)).select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, size: int = WIDE_SHINGLE, width: int = WIDE_WORDS, radius: int = REACH, early: int = EARLY) -> DataFrame:
    """near_duplicates() by the confirmed similarity: doc_id, fp (binary), component_id; the same null and tie rules."""
    rows = materialize(wide_fingerprints(docs, size, width), "wide")

    def links_of(fps: DataFrame) -> DataFrame:
        return confirmed(docs, fps, components(wide_links(fps, radius, early=early)), size, radius, early)

    return _named(rows, links_of, "wide", ("fp", "text_hash"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Null text is empty; texts without words have fingerprint 0 and are linked like any other. A null doc_id is never a
    component_id unless its whole component has none. Repeated rows and extra columns are fine; an empty table gives
    an empty result.
    """
    rows = materialize(fingerprints(docs, size, seed), "simhash")

    def numbered(fps: DataFrame) -> DataFrame:
        """Links between nodes, from links between fingerprints."""
        found = links(fps, radius)
        nodes = [fps.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}")) for c in ("a", "b")]
        return found.join(nodes[0], "a").join(nodes[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    return _named(rows, numbered, "simhash")


def hex_digits(fp: str = "fp"):
    """A fingerprint column as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each group of similar() texts: the one with the smallest doc_id, nulls last; all columns kept.

    Rows that repeat that doc_id are told apart by their place in the table. Texts without words are one group.
    """
    (at,) = fresh(docs.columns, "at")
    rows = located(docs, at)
    found = similar(rows.select(F.col(at).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("of"), "component_id")
    own = rows.select(F.col("doc_id").cast("long").alias("own_id"), F.col(at).alias("own"))
    first = F.min(F.struct(F.col("own_id").isNull(), "own_id", "own"))["own"]
    placed = materialize(found.join(own, F.col("of") == F.col("own")), "simhash-placed")
    stays = placed.groupBy(F.col("component_id").alias("component")).agg(first.alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = placed.join(stays, F.col("component_id") == F.col("component")).where("own <> stays").select("own")
    return without(rows, at, gone).select(*docs.columns)
