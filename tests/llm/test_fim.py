"""Fill-in-the-middle against a plain version that lists the units of each text."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.llm import fim
from tallyglass.llm.textbytes import raw

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def expected(doc_id, text, seed=1, fim_percent=90, spm_percent=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim_percent:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < spm_percent:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "a", "1", "word", "two words", "é", "漢字 and 🙂🙂 more", "a<P>b", "<", "<S", "S>", "<P", "x<", "\n\n\n", "a1b2c3", "<<P<S<M", "end<S\n>", "\x00nul", "word " * 40_000, "🙂" * 70_000, "y" * 300_000]
    ids = [*range(120), None, -3, 2**40]
    return [(d, texts[(k * 7 + k // 22) % len(texts)], "en", "s", 1) for k, d in enumerate(ids)] + [(5, "two words", None, None, None)] * 2


@pytest.mark.parametrize("n", [1, 5])
def test_outputs_and_round_trip(spark, rows, n):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(n)
    made = fim.transform(docs)
    assert sorted(map(repr, (tuple(r) for r in made.collect()))) == sorted(repr(expected(r[0], r[1])) for r in rows)
    back = made.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted(map(repr, (tuple(r) for r in back))) == sorted(repr((r[0], r[1] or "")) for r in rows)


def test_other_shares_and_seeds(spark, rows):
    got = fim.transform(spark.createDataFrame(rows, SCHEMA), seed=9, fim_percent=60, spm_percent=50).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(expected(r[0], r[1], 9, 60, 50)) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_tables_and_clashing_columns(spark, rows):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cut", "2 AS h1", "3 AS form", "4 AS output", "5 AS N", "6 AS middle_chars")
    assert sorted(repr(tuple(r)) for r in fim.transform(wide).collect()) == sorted(repr(expected(r[0], r[1])) for r in rows)
    kept = fim.transform(wide, columns=True)
    assert kept.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text", "lang", "source", "n_chars", "cut", "h1"]
    assert kept.where("coalesce(text, '') <> '' AND form = 'plain' AND output <> text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ1 é漢🙂\n<", max_size=20), min_size=1, max_size=6))
def test_runs_find_every_cut(texts):
    data, offsets = raw(pa.array(texts, pa.string()))
    r = fim.runs(data, offsets)
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert np.diff(r.before).tolist() == [len(u) for u in units]
    assert len(r.start) == sum(len(re.findall("[A-Za-z]+|[^A-Za-z]+", t)) for t in texts)
    for k in range(max(map(len, units)) + 1):
        at = np.array([min(k, len(u)) for u in units])
        assert fim.places(r, at).tolist() == [len("".join(u[:n])) for u, n in zip(units, at, strict=True)]
