"""Exact dedup after failed and repeated calls."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import exact_dedup

SCHEMA = "doc_id long, text string"
ROWS = [(1, "a b"), (2, "ab "), (3, "c"), (4, None), (5, ""), (6, "d")]
MORE = [(7, "a  b"), (8, "c"), (9, "e"), (None, "e")]


def outcome(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


def weak(t):
    """Sixteen digests, so that different texts share one."""
    return F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(t, 256), 1, 1)))


@pytest.fixture
def rows(spark):
    return lambda data: spark.createDataFrame(data, SCHEMA).repartition(3)


def test_a_call_made_again_adds_nothing(rows, tmp_path):
    at = str(tmp_path / "ck")
    want = outcome(exact_dedup.exact_dedup(rows(ROWS)))
    for _ in range(3):
        assert outcome(exact_dedup.exact_dedup(rows(ROWS[::-1]), checkpoint=at)) == want
    exact_dedup.add_batch(rows(ROWS), at)
    assert outcome(exact_dedup.exact_dedup(rows(ROWS), checkpoint=at)) == want


def test_names_tell_calls_apart(rows, tmp_path):
    at = str(tmp_path / "ck")
    first = outcome(exact_dedup.exact_dedup(rows(ROWS), checkpoint=at, call="monday / 1"))
    again = outcome(exact_dedup.exact_dedup(rows(ROWS), checkpoint=at, call="tuesday"))
    assert {r[0]: 2 * r[2] for r in first} == {r[0]: r[2] for r in again} and not any(r[3] for r in again)
    assert {r[0]: r[2] for r in outcome(exact_dedup.exact_dedup(rows(ROWS), checkpoint=at, call="monday / 1"))} == {r[0]: r[2] for r in again}


@pytest.mark.parametrize("step", ["update_state", "read_state", "find_clashes", "check_batch", "half written", "half written, then another"])
def test_a_call_that_failed_anywhere_can_be_made_again(spark, rows, tmp_path, monkeypatch, step):
    digest = weak  # with clashes, whose check is part of what must be made up for

    def both(at):
        a = exact_dedup.exact_dedup(rows(ROWS), digest, at)
        return outcome(a), outcome(exact_dedup.exact_dedup(rows(MORE), digest, at))

    want = both(str(tmp_path / "whole"))
    at = str(tmp_path / "broken")
    if step.startswith("half"):
        exact_dedup.add_batch(rows(ROWS), at, digest)
        content = Path(at) / "content" / "batch=0"
        (content / "_SUCCESS").unlink()
        next(content.glob("part-*")).unlink()
    else:
        def crash(*args, **more):
            raise RuntimeError("lost the driver")

        with monkeypatch.context() as m:
            m.setattr(exact_dedup, step, crash)
            for _ in range(2):
                with pytest.raises(RuntimeError):
                    exact_dedup.exact_dedup(rows(ROWS), digest, at)
    if step.endswith("another"):  # the failed call is not made again before the next one
        later = exact_dedup.exact_dedup(rows(MORE), digest, at)
        assert outcome(later) == outcome(exact_dedup.exact_dedup(rows(MORE), digest, str(tmp_path / "alone")))
        assert {r[0]: r[2] for r in outcome(exact_dedup.exact_dedup(rows(ROWS), digest, at))} == {1: 3, 2: 3, 3: 2, 4: 2, 5: 2, 6: 1}
        return
    assert both(at) == want


def test_what_a_lost_call_left_unchecked_is_checked_by_the_next(rows, tmp_path, monkeypatch):
    at, whole = str(tmp_path / "broken"), str(tmp_path / "whole")
    exact_dedup.exact_dedup(rows(ROWS), weak, whole)
    want = outcome(exact_dedup.exact_dedup(rows(MORE), weak, whole))
    exact_dedup.exact_dedup(rows(ROWS), weak, at)
    shutil.rmtree(Path(at) / "clashes")  # as if the driver was lost just before
    assert outcome(exact_dedup.exact_dedup(rows(MORE), weak, at)) == want
