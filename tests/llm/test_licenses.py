"""The license scan as a query: nothing is lost before texts are compared."""

import random
import re
import textwrap

import pyarrow as pa
import pytest

from tallyglass.llm import licenses

MARKS = ("", "# ", " * ", "// ", "-- ")


def wrapped(text, width, mark):
    lines = [x for part in re.sub(r"(?<=[a-z:])\n", "\n\n", text).split("\n\n") for x in [*textwrap.wrap(part, width, break_on_hyphens=False), ""]]
    return "\n".join((mark + x).rstrip() for x in lines)


@pytest.fixture(scope="module")
def held():
    """(name, document) of every license text and notice at all widths behind all marks, license texts with words changed too."""
    rng = random.Random(6)
    out = []
    for mark in MARKS:
        for name, text in licenses.TEXTS.items():
            plain = text.replace("{v}", "2.0")
            out += [(name, "int x;\n\n" + wrapped(plain, width, mark) + "\n\nint y;") for width in (48, 72, 80)]
            words = plain.split()
            allowed = int(licenses.MAX_DIFFERENT * len(licenses.words(text)))
            for k in sorted(rng.sample(range(len(words)), allowed - 2), reverse=True):
                words[k] = rng.choice(["changed", "", "two words"][:2])
            out.append((name, f"{mark}" + f"\n{mark}".join(textwrap.wrap(" ".join(words), 70))))
        for name, text in licenses.NOTICES.items():
            out += [(name, f"{mark}Copyright\n{mark}\n" + wrapped(text.replace("{v}", "4.0"), width, mark) + "\nx = 1\n") for width in (30, 80)]
    return out


def test_every_template_is_found_through_the_query(spark, held):
    rows = [(i, text) for i, (_, text) in enumerate(held)]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    one_of = {"0BSD-text": {"0BSD-text", "ISC-text"}, "ISC-text": {"0BSD-text", "ISC-text"}, "BSD-2-Clause-text": {"BSD-2-Clause-text", "BSD-3-Clause-text"}}
    missed = [(i, name) for i, (name, _) in enumerate(held) if not any((i, n) in got for n in (one_of.get(name) or {name}))]
    assert not missed


def test_the_query_equals_a_scan_of_each_text(spark, held):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10**6 + i, text) for i, (_, text) in enumerate(held[::7])] + [(-1, None), (None, ""), (5, held[0][1]), (5, held[0][1])]
    want = sorted(repr((d, *hit)) for d, text in rows for hit in licenses.scan_text(text or ""))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr(tuple(r)) for r in got) == want and len(want) > 40


def test_documents_that_may_hold_a_text_are_few():
    rng = random.Random(1)
    vocabulary = "the of and to a in this for with not by any other you may use software copyright terms provided that is".split()
    prose = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(300)]
    assert licenses.may_hold(pa.array([*prose, "", None]), licenses.TEXTS).sum() < 30
    assert not licenses.may_hold(pa.array(prose), {}).any()


def test_many_copies_in_one_document_take_no_long():
    text = "\n\n".join([licenses.TEXTS["MIT-text"], licenses.TEXTS["BSD-3-Clause-text"]] * 30)
    assert [h[0] for h in licenses.scan_text(text)] == ["MIT-text", "BSD-3-Clause-text"] * 30
