"""Fill-in-the-middle: each document is cut into prefix, middle and suffix and laid out so that the middle comes last.

The unit is a run of letters or one other character (`[A-Za-z]+|[^A-Za-z]`), so a cut never falls inside a word. Texts
are stored as run-length codes of the two character classes: maximal runs with their starts and cumulative unit counts. A run
of letters is one unit, any other run has as many units as characters; the run that holds a cut is found by binary
search in the cumulative counts and the place in it by subtraction. Python receives the texts and gives back three
numbers a row; the texts themselves stay in the JVM, where the pieces are put together. Nothing is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import fresh, text_of
from tallyglass.llm.textbytes import chunks

#: The marks before prefix, suffix and middle, and any of them.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Runs(NamedTuple):
    """Maximal runs of one character class of consecutive texts; a run never crosses texts."""

    start: np.ndarray  #: first code point of each run, over all texts
    letters: np.ndarray  #: whether the run is one unit
    units: np.ndarray  #: units before each run, over all texts
    texts: np.ndarray  #: n + 1: first code point of each text
    before: np.ndarray  #: n + 1: units before each text


def runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """The runs of texts given as UTF-8 bytes and n + 1 byte offsets."""
    leads = (data & 0xC0) != 0x80  # one byte a code point
    texts = np.concatenate([[0], np.cumsum(leads)])[offsets]
    letter = LETTER[data[leads]]
    first = np.ones(len(letter), bool)
    first[1:] = letter[1:] != letter[:-1]
    first[texts[:-1][texts[:-1] < len(letter)]] = True
    start = np.flatnonzero(first)
    kind = letter[start]
    size = np.where(kind, 1, np.diff(start, append=len(letter)))
    total = np.concatenate([[0], np.cumsum(size)])
    return Runs(start, kind, total[:-1], texts, total[np.searchsorted(start, texts)])


def places(r: Runs, unit: np.ndarray) -> np.ndarray:
    """Code points of each text before its unit number `unit`, which is at most its number of units."""
    end = np.append(r.start, r.texts[-1])  # a cut at the very end is at the start of a run that is not there
    total = np.append(r.units, r.before[-1])
    at = r.before[:-1] + unit
    run = np.searchsorted(total, at, "right") - 1
    inside = np.where(np.append(r.letters, False)[run], 0, at - total[run])
    return end[run] + inside - r.texts[:-1]


def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    columns = [np.zeros(len(text), np.int64) for _ in range(3)]
    draws = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (one, two)]
    for i, j, data, offsets in chunks(text):
        r = runs(data, offsets)
        n = np.diff(r.before)
        a, b = (d[i:j] % (n + 1) for d in draws)
        first = places(r, np.minimum(a, b))
        for out, value in zip(columns, (n, first, places(r, np.maximum(a, b)) - first), strict=True):
            out[i:j] = value
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "prefix_chars", "middle_chars"])


def draws(seed: int, key: str = "doc_id") -> list[Column]:
    """Four numbers below 2 ** 32 from the seed and a key: the first digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, columns: bool = False) -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    form is `psm` (`<P>`prefix`<S>`suffix`<M>`middle), `spm` (`<S>`suffix`<P>`prefix`<M>`middle) or `plain` (the text). Texts
    without a character, texts that hold a mark already, and all but `fim_percent` of the rest stay plain; of the others
    `spm_percent` are spm. The cuts are drawn from the seed and doc_id, so rows that repeat a doc_id are drawn alike. Null text is
    empty and plain; a null doc_id is drawn as the empty key. `columns` keeps the other columns, whatever their names,
    under those names unless one of the result's has it. An empty table gives no rows.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    others = [c for c in docs.columns if columns and c.lower() not in names]
    text, cut, *drawn = fresh(docs.columns, "text", "cut", "h1", "h2", "h3", "h4")
    cuts = F.arrow_udf(_cuts, "n long, prefix_chars long, middle_chars long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias(text), *[F.col(c) for c in others])
    rows = rows.withColumns(dict(zip(drawn, draws(seed), strict=True)))
    rows = rows.withColumn(cut, cuts(text, drawn[0], drawn[1]))
    plain = (F.length(text) == 0) | F.col(text).rlike(MARK) | (F.col(drawn[2]) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col(drawn[3]) % 100 < spm_percent, "spm").otherwise("psm")
    p, m = F.col(f"{cut}.prefix_chars"), F.col(f"{cut}.middle_chars")
    piece = lambda start, size=None: F.substring(text, (start + 1).cast("int"), (F.lit(2**31 - 1) if size is None else size).cast("int"))
    prefix, middle, suffix = piece(F.lit(0), p), piece(p, m), piece(p + m)
    put = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    put = put.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col(text))
    turned = F.col("form") != "plain"
    found = rows.withColumn("form", form)
    return found.select("doc_id", F.col(f"{cut}.n").alias("n"), "form", F.when(turned, p).alias("prefix_chars"), F.when(turned, m).alias("middle_chars"), put.alias("output"), *others)


def restored(form: Column, output: Column) -> Column:
    """The text that an output of transform() was made from. No mark can begin inside another, so the marks found are those put in."""
    pieces = F.split(output, MARK, -1)
    psm = F.concat(F.element_at(pieces, 2), F.element_at(pieces, 4), F.element_at(pieces, 3))
    spm = F.concat(F.element_at(pieces, 3), F.element_at(pieces, 4), F.element_at(pieces, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
