"""Language models come from all labelled rows, at any partitioning (F13)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyglass.llm import langid, textbytes

WORDS = {"en": "the house of words and water", "de": "das haus der wörter und wasser", "fr": "la maison des mots et de l'eau"}


def corpus(spark, n=300):
    rows = [(i, f"{WORDS[la]} {WORDS[la][i % 9 :]} {i % 7 * 'ab '}".strip(), la) for i in range(n) for la in [sorted(WORDS)[i % 3]]]
    return spark.createDataFrame([(i, None if i % 50 == 7 else "12 34" if i % 50 == 9 else t, la) for i, t, la in rows], "doc_id long, text string, lang string")


def test_document_counts_and_centroids_are_those_of_all_rows(spark):
    docs = corpus(spark)
    model = langid.fit(docs, sample_rows=3)
    apart = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.lit("reach")), F.lit(langid.APART)) == 0
    rows = docs.where(~apart & F.col("text").rlike("[a-z]")).collect()
    found = langid.counts(*textbytes.raw(pa.array([r.text for r in rows])))
    assert np.allclose(model.idf, np.log((1 + len(found)) / (1 + (found > 0).sum(axis=0))) + 1)
    # each centroid is the mean direction of rows of its language; together they hold all rows, so the pooled one is near all of them
    x = langid.vectors(found, model.idf)
    for language in WORDS:
        own = x[[r.lang == language for r in rows]]
        centres = model.centroids[[la == language for la in model.languages]]
        assert (own @ centres.T).max(axis=1).min() > 0.6 and np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-5)


def test_the_model_is_the_same_at_any_partitioning(spark):
    docs = corpus(spark)
    a, b = langid.fit(docs.repartition(1)), langid.fit(docs.repartition(9, "text"))
    assert a.languages == b.languages and all((getattr(a, k) == getattr(b, k)).all() for k in ("idf", "centroids", "reach"))


def test_quantile_of_counted_distances(spark):
    draw = np.random.default_rng(5)
    for n in (1, 7, 1000, 5000):
        d = draw.integers(0, 500, n)
        bins = spark.createDataFrame([("a", 1, int(v), int(c)) for v, c in zip(*np.unique(d, return_counts=True), strict=True)], "language string, length long, distance long, n long")
        r = langid.upper(bins).first()
        assert (r.n, r.q) == (n, int(np.quantile(d, langid.WITHIN, method="higher")))
