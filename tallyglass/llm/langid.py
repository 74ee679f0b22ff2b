"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of its hashed byte n-grams (letters only, lower case). Each language has
several centroids, found by spherical k-means over all labelled texts. A text gets the language of the
centroid with the largest cosine; it is rejected where it has no letter, or where its cosine distance to that centroid
is beyond the reach of the language for texts of its length. The reach is measured on labelled texts that the centroids
have not seen, whole and in an excerpt of every class of length, so that each class has as many as there are texts: nearly
their largest distance, a little more, and no less for a shorter class than for a longer one.

Fitting reads every labelled text whole: three quarters give the document counts and, in `ROUNDS` passes, the centroids; the
rest gives the reach. A sample of `sample_rows` rows, shared evenly among the languages and chosen by a hash of doc_id, says
only where the centroids start. Tasks hold sums of whole numbers, so the model is the same at any partitioning; the driver
gets one vector a centroid. Prediction reads every text whole and holds only the centroids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm import textbytes
from tallyglass.llm.common import give_back, lean, text_of

DIMENSIONS = 4096
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 2000
CENTROIDS = 4
#: Rows of a language that its centroids start from, at least; and rounds over all rows that then move them.
LEAST_START = 64
ROUNDS = 3
#: One labelled row in APART is set aside: centroids do not see it, and its distances give the reach.
APART = 4
#: Distances are counted in steps of 1 / GRID, rounded up.
GRID = 1 << 16
#: Texts shorter than each number of letter bytes have a reach of their own.
LENGTHS = (8, 16, 32, 64, 128, 256, 512)
#: Share of the checked texts and excerpts within reach before the margin; the margin, as a share of the remaining distance to 1, is MARGIN and
#: UNSURE over the root of how many there were.
WITHIN = 0.999
MARGIN, UNSURE = 0.1, 0.5
#: A reach is no less: texts that repeat a few words of a language are that far from its centroids, other languages farther.
LEAST_REACH = 0.65
#: Reach of a language that no checked text was nearest to; and rows of a language from which on some are set aside to be checked.
REJECT_BEYOND = 0.9
LEAST_SPLIT = 4
UNKNOWN = "und"
#: Rows that are lower-cased and predicted together.
SLICE = 1024
#: Unit vectors are compared in whole multiples of 1 / ONE: their products add up below 2**53, exactly and in any order.
ONE = 2.0**24

#: ASCII letters as themselves in lower case, bytes of other characters as they are, all else a blank.
FOLDED = np.full(256, 0x20, np.uint8)
FOLDED[0x80:] = np.arange(0x80, 0x100)
FOLDED[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLDED[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


@dataclass(frozen=True)
class Model:
    """languages: of each centroid; reach: the largest distance each centroid's language accepts, by class of length."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray


def counts(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed n-gram counts of each text, as rows; n-grams of blanks alone are left out and none crosses texts."""
    n = len(offsets) - 1
    folded = FOLDED[data].astype(np.uint32)
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    out = np.zeros(n * dimensions, np.float32)
    for order in ORDERS:
        m = len(folded) - order + 1
        if m <= 0:
            break
        gram, black = np.full(m, order, np.uint32), np.zeros(m, bool)
        for k in range(order):
            gram = gram << np.uint32(8) | folded[k : k + m]
            black |= folded[k : k + m] != 0x20
        black &= text[:m] == text[order - 1 :]
        bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - dimensions.bit_length() + 1)
        out += np.bincount((text[:m] * dimensions + bucket)[black], minlength=n * dimensions).astype(np.float32)
    return out.reshape(n, dimensions)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(found) * idf)


def length_class(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which of the classes that LENGTHS parts each text's number of letter bytes is in."""
    seen = np.concatenate([[0], np.cumsum(FOLDED[data] != 0x20)])
    return np.searchsorted(LENGTHS, seen[offsets[1:]] - seen[offsets[:-1]], "right")


def fixed(rows: np.ndarray) -> np.ndarray:
    return np.rint(rows.astype(np.float64) * ONE)


def nearest(found: np.ndarray, idf: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and cosine to it, of rows of counts; the same whatever rows come with a row."""
    cosine = fixed(vectors(found, idf)) @ fixed(centroids).T / ONE**2
    top = cosine.argmax(axis=1)
    return top, np.clip(cosine[np.arange(len(top)), top], 0, 1)


def reaches(seen: list[tuple[str, int, float]], languages: list[str], reject_beyond: float = REJECT_BEYOND) -> np.ndarray:
    """reach_table() of (nearest language, class of length, distance) of what was checked."""
    own = {(la, c): [d for x, k, d in seen if (x, k) == (la, c)] for la, c in {x[:2] for x in seen}}
    return reach_table({k: (len(d), float(np.quantile(d, WITHIN, method="higher"))) for k, d in own.items()}, languages, reject_beyond)


def reach_table(quantiles: dict[tuple[str, int], tuple[int, float]], languages: list[str], reject_beyond: float = REJECT_BEYOND) -> np.ndarray:
    """Reach of each centroid's language by class of length, from how many were nearest to it in a class and their quantile.

    A language that nothing was nearest to in a class has its reach for longer texts there.
    """
    out = np.full((len(languages), len(LENGTHS) + 1), np.nan, np.float32)
    for language in set(languages):
        at, longer = [x == language for x in languages], np.nan
        for c in range(len(LENGTHS), -1, -1):
            n, q = quantiles.get((language, c), (0, np.nan))
            margin = MARGIN + UNSURE / max(1, n) ** 0.5
            out[at, c] = longer = np.fmax(longer, np.fmax(LEAST_REACH, q + min(1.0, margin) * (1 - q)) if n else np.nan)
    return np.where(np.isnan(out), reject_beyond, out).astype(np.float32)


def excerpts(text: str) -> list[str]:
    """A piece of whole words from within a text for each class of length that it exceeds; how long varies within the class."""
    words, out = text.split(), []
    start = len(words) // 3
    for low, high in zip((1, *LENGTHS), LENGTHS, strict=False):
        wanted, size, held = low + (len(words) * 7 + high) % (high - low), 0, []
        for word in words[start:]:
            size += sum(c.isalpha() for c in word)
            held.append(word)
            if size >= wanted:
                out.append(" ".join(held))
                break
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; starts from the mean, then the row farthest from those chosen. Deterministic."""
    chosen = [unit(x.mean(axis=0, keepdims=True))[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[(x @ np.array(chosen).T).max(axis=1).argmin()])
    centres = np.array(chosen)
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        centres = np.array([unit(x[nearest == c].mean(axis=0, keepdims=True))[0] if (nearest == c).any() else centres[c] for c in range(len(centres))])
    return centres


def totals(rows: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sums over all rows (label, text) that have letters, as `size` vectors of DIMENSIONS + 1 whole numbers.

    `add` gives a task's sums what a batch of counts with its labels adds. They are whole numbers, so no order changes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, DIMENSIONS + 1), np.int64)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                text = lowered(batch.column(1).slice(at, SLICE))
                labels, letters = np.array(batch.column(0).slice(at, SLICE).to_pylist(), object), has_letter(text)
                for i, j, data, offsets in textbytes.chunks(text, rows=256):
                    known = letters[i:j]
                    if known.any():
                        add(sums, counts(data, offsets)[known], labels[i:j][known])
        vector, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(vector.astype(np.int64)), pa.array(bucket.astype(np.int64)), pa.array(sums[vector, bucket])], ["vector", "bucket", "total"])

    found = rows.mapInArrow(lean(run), "vector long, bucket long, total long").groupBy("vector", "bucket").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros((size, DIMENSIONS + 1), np.int64)
    out[found["vector"].to_numpy(), found["bucket"].to_numpy()] = found["total"].to_numpy()
    return out


def moved(rows: DataFrame, idf: np.ndarray, languages: list[str], centroids: np.ndarray) -> np.ndarray:
    """A round of spherical k-means over all rows: each goes to the nearest centroid of its own language; none keeps a centroid where it is."""
    spread = rows.sparkSession.sparkContext.broadcast((idf, centroids, np.array(languages, object)))

    def add(sums: np.ndarray, found: np.ndarray, labels: np.ndarray) -> None:
        idf, centres, names = spread.value
        x = fixed(vectors(found, idf))
        cosine = np.where(labels[:, None] == names[None, :], x @ fixed(centres).T, -np.inf)
        top, own = cosine.argmax(axis=1), np.isfinite(cosine).any(axis=1)
        one = np.zeros((len(centres), len(x)))
        one[top[own], np.nonzero(own)[0]] = 1
        sums[:, :-1] += (one @ x).astype(np.int64)
        sums[:, -1] += one.sum(axis=1).astype(np.int64)

    sums = totals(rows, len(languages), add)
    return np.where(sums[:, -1:] > 0, unit(sums[:, :-1].astype(np.float64)), centroids).astype(np.float32)


def fit(docs: DataFrame, label: str = "lang", sample_rows: int = SAMPLE_ROWS, per_language: int = CENTROIDS, reject_beyond: float = REJECT_BEYOND) -> Model:
    """Learn from all rows with a label and a text that has letters; a sample of them only says where centroids start."""
    usable = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    apart = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text_of(), F.lit("reach")), F.lit(APART)) == 0
    counted = usable.groupBy(F.col(label).cast("string")).agg(F.count(F.lit(1)), F.count_if(apart)).collect()
    if not counted:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, len(LENGTHS) + 1), np.float32))
    #: Rows set aside by language; one with few rows gives none.
    aside = {r[0]: r[2] if LEAST_SPLIT <= r[2] < r[1] else 0 for r in counted}
    sizes = {r[0]: r[1] - aside[r[0]] for r in counted}
    share = max(LEAST_START, sample_rows // len(sizes))
    million = 1_000_000
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(million))
    learned, start = F.lit(False), F.lit(False)
    for language, n in sizes.items():
        own = (F.col(label) == language) & (~apart if aside[language] else F.lit(True))
        learned |= own
        start |= own & (draw < int(np.ceil(million * min(1.0, share / n))))
    named = [F.col(label).cast("string").alias("label"), text_of().alias("text")]
    rows = usable.where(learned).select(*named)

    def seen_in(sums: np.ndarray, found: np.ndarray, labels: np.ndarray) -> None:
        sums[0, :-1] += (found > 0).sum(axis=0)
        sums[0, -1] += len(found)

    seen = totals(rows, 1, seen_in)[0]
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = lowered(batch.column(1))
            letters = has_letter(text)
            for i, j, data, offsets in textbytes.chunks(text, rows=256):
                found = counts(data, offsets)
                kept = [(found[k].tobytes(), ok) for k, ok in enumerate(letters[i:j])]
                arrays = [batch.column(0).slice(i, j - i), pa.array([r[0] for r in kept], pa.binary()), pa.array([bool(r[1]) for r in kept])]
                yield pa.RecordBatch.from_arrays(arrays, ["label", "counts", "letters"])

    first = usable.where(start).select(*named).mapInArrow(lean(count), "label string, counts binary, letters boolean").where("letters").limit(2 * share * len(sizes)).collect()
    first.sort(key=lambda r: (r.label, bytes(r.counts)))
    x = vectors(np.array([np.frombuffer(r.counts, np.float32) for r in first]).reshape(-1, DIMENSIONS), idf).astype(np.float32)
    labels = np.array([r.label for r in first])
    del first
    languages, centroids = [], []
    for language in sorted(set(labels)):
        centres = spherical_kmeans(x[labels == language], per_language)
        languages += [language] * len(centres)
        centroids.append(centres)
    del x
    give_back()
    centroids = np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, DIMENSIONS), np.float32)
    for _ in range(ROUNDS if languages else 0):
        centroids = moved(rows, idf, languages, centroids)
    spread = docs.sparkSession.sparkContext.broadcast((idf, centroids))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                whole = lowered(batch.column(0).slice(at, 64))
                text = pa.array([x for t in whole.to_pylist() for x in (t, *excerpts(t))], pa.string())
                letters = has_letter(text)
                for i, j, data, offsets in textbytes.chunks(text, rows=256):
                    top, score = nearest(counts(data, offsets), *spread.value)
                    arrays = [pa.array(a[letters[i:j]]) for a in (top.astype(np.int64), length_class(data, offsets).astype(np.int64), np.ceil((1 - score) * GRID).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, ["top", "length", "distance"])

    checked = reduce(Column.__or__, [(F.col(label) == la) & apart for la, n in aside.items() if n], F.lit(False))
    quantiles = {}
    if languages and any(aside.values()):
        spoken = F.element_at(F.array(*map(F.lit, languages)), (F.col("top") + 1).cast("int"))
        distances = usable.where(checked).select(text_of().alias("text")).mapInArrow(lean(measure), "top long, length long, distance long")
        bins = distances.groupBy(spoken.alias("language"), "length", "distance").agg(F.count(F.lit(1)).alias("n"))
        quantiles = {(r.language, r.length): (r.n, r.q / GRID) for r in upper(bins).collect()}
    return Model(languages, idf, centroids, reach_table(quantiles, languages, reject_beyond))


def upper(bins: DataFrame) -> DataFrame:
    """language, length, n, q: how many and their quantile at WITHIN, the higher of two, from counts n of each distance; at most GRID + 1 rows a group."""
    group = Window.partitionBy("language", "length")
    below = F.sum("n").over(group.orderBy("distance"))
    known = bins.select("language", "length", "distance", below.alias("below"), F.sum("n").over(group).alias("n"))
    return known.where(F.col("below") > F.ceil(F.lit(WITHIN) * (F.col("n") - 1))).groupBy("language", "length").agg(F.first("n").alias("n"), F.min("distance").alias("q"))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred, score (cosine to the nearest centroid) and rejected.

    Null texts and texts without a letter are `und` with score 0 and rejected, as is everything under an empty model.
    Equal texts get equal predictions. Columns of docs with a result's name are replaced by the result.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    names = ("lang_pred", "score", "rejected")
    shown = [c for c in (docs.columns if keep is None else keep) if c not in names]
    base = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else c for c in dict.fromkeys((*shown, "text"))])
    at, kept = base.columns.index("text"), [i for i, c in enumerate(base.columns) if c in shown]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        languages = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                part = batch.slice(k, SLICE)
                text = lowered(part.column(at))
                known = has_letter(text) & bool(m.languages)
                best, score, far = np.full(len(text), len(languages) - 1), np.zeros(len(text)), np.ones(len(text), bool)
                for i, j, data, offsets in textbytes.chunks(text, rows=256) if m.languages else ():
                    top, cosine = nearest(counts(data, offsets), m.idf, m.centroids)
                    best[i:j], score[i:j] = top, cosine
                    far[i:j] = 1 - score[i:j] > m.reach[top, length_class(data, offsets)]
                best, score, far = np.where(known, best, len(languages) - 1), np.where(known, score, 0.0), far | ~known
                arrays = [*(part.column(c) for c in kept), pa.array(languages[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(far)]
                yield pa.RecordBatch.from_arrays(arrays, [*shown, *names])

    schema = base.select(*shown).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return base.mapInArrow(lean(run), schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the rows that are not held out."""
    model = fit(docs.where(~held_out()))
    found = predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that the classifier rejects; it learns from all labelled rows of `docs`. Columns unchanged."""
    clash = {c: f"__own_{c}" for c in docs.columns if c in ("lang_pred", "score", "rejected")}
    found = predict(docs.withColumnsRenamed(clash), fit(docs)).where(~F.col("rejected"))
    return found.drop("lang_pred", "score", "rejected").withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
