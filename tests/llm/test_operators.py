"""Every operator against a brute-force version on small, awkward inputs."""

import collections
import hashlib
import random
import re
import struct
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyglass.llm import exact_dedup, langid, licenses, minhash, mixing, packing, pretokens, simhash, suffix_dedup, textbytes, token_counts, token_files
from tallyglass.llm.common import materialize
from tallyglass.llm.components import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ("key", "kind", "digest", "fp", "bucket", "token", "lang_pred", "score", "root", "node", "rows", "epoch", "k", "guest", "range", "number", "raw", "first")


def long_text(words: int = 30_000) -> str:
    rng = random.Random(8)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(4)
    words = ["the", "of", "le", "être", "und", "straße", "que", "señor", "A", "don't", "12.5", "licence", "x" * 30]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(300)
    out = [
        (1, base, "en", "src0", 5), (2, base, "en", "src0", 5), (3, base.replace(" ", "  "), "fr", "src1", 5), (4, base + " tail", "de", None, 5), (5, None, "en", "src1", None),
        (6, "", None, "src2", 0), (7, " \n\t ", "es", "src2", 4), (None, text(20), "en", "src3", 1), (None, None, None, None, None), (9, "One word", "en", "src0", 8),
        (9, "One word", "en", "src0", 8), (10, "One  word", "de", "src0", 8), (11, long_text(), "fr", "src0", 1), (12, "1234 !!", "en", "src1", 7), (13, "Ω漢字 <|endoftext|> İ", "es", "src4", 9),
    ]
    return out + [(20 + i, text(rng.randint(0, 60)), rng.choice(["en", "fr", None]), f"src{i % 4}", 1) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def key(row):
    return tuple((v is not None, v) for v in row)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


OPERATORS = {
    "minhash": minhash.fingerprint_neighbours,
    "token_files": lambda d: token_files.read_token_files(d.sparkSession, token_files.write_token_files(d, TOKENIZER)),
    "suffix_dedup": suffix_dedup.suffix_dedup,
    "langid": langid.identify,
    "packing": lambda d: packing.pack(d, TOKENIZER),
    "exact_dedup": lambda d: exact_dedup.exact_dedup(d).drop("digest"),
    "mixing": mixing.mix_sources,
    "simhash": simhash.near_duplicates,
    "similar": lambda d: simhash.similar(d).drop("fp"),
    "token_counts": lambda d: token_counts.token_counts(d, TOKENIZER, 2048),
    "licenses": licenses.scan,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(name, empty):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_and_partitioning_change_nothing(name, docs):
    if name == "packing":  # any numbers may name the sequences
        shape = lambda d: collected(OPERATORS[name](d).drop("sequence_id", "offset"))
    else:
        shape = lambda d: collected(OPERATORS[name](d))
    assert shape(docs) == shape(clashing(docs).repartition(5))


# ---- 1 MinHash ------------------------------------------------------------------------------------------------------


def shingles(text, size=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_minhash_neighbours_and_likeness(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = collections.Counter()
    errors = []
    got = collections.defaultdict(list)
    for r in minhash.fingerprint_neighbours(docs).collect():
        got[r.doc_id, r.n_chars, r.edited_sha256].append(r)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        text, nxt = a[1] or "", b[1] or ""
        edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        k = (a[0], len(text), hashlib.sha256(edited.encode()).hexdigest())
        want[k] += 1
        for other, column in ((edited, "near_edited"), (nxt, "near_next")):
            x, y = shingles(text), shingles(other)
            true = len(x & y) / len(x | y) if x | y else 1.0
            errors.append(abs(getattr(got[k][0], column) - true))
    assert {k: len(v) for k, v in got.items()} == want
    assert max(errors) < 0.15 and np.mean(errors) < 0.02


def test_minhash_equal_texts_equal_fingerprints_and_bias():
    texts = pa.array([b"a b c d e f", b"A  b c\nd e f", b"", b"  ", b"one"], pa.binary())
    prints = minhash.fingerprints(texts)
    assert prints[0] == prints[1] != prints[4] and prints[2] == prints[3] == b"" and len(prints[4]) == minhash.BINS * minhash.BITS // 8
    rng = random.Random(1)
    far = minhash.fingerprints(pa.array([" ".join(str(rng.random()) for _ in range(400)) for _ in range(60)], pa.string()))
    assert np.mean([minhash.likeness(a, b) for a, b in zip(far, far[1:], strict=False)]) < 0.01
    assert minhash.likeness(b"", b"") == 1.0 and minhash.likeness(b"", far[0]) == 0.0


def test_densification_fills_every_bin_alike():
    least = np.full((3, minhash.BINS), minhash.EMPTY, np.uint64)
    least[0, 5] = least[1, 5] = 9
    full = minhash.densify(least)
    assert (full[0] == 9).all() and (full[0] == full[1]).all() and (full[2] == minhash.EMPTY).all()


# ---- 2, 5, 9 tokens -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ids(rows):
    tok = Tokenizer.from_file(TOKENIZER)
    return [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]


def crc(values):
    return zlib.crc32(struct.pack(f"<{len(values)}I", *values))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(max_size=40) | st.text("aB 1'sé.", max_size=40), max_size=8))
def test_pretokens_equal_the_library(name, texts):
    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        cache = pretokens.packed_ids(f.read(), "<u2")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in cache.values(texts)] == want


def test_pretoken_cache_forgets_and_stays_right():
    with open(TOKENIZER, encoding="utf-8") as f:
        cache = pretokens.PretokenCache(f.read(), len, sum, entries=3)
    tok = Tokenizer.from_file(TOKENIZER)
    for text in ("alpha beta gamma delta", "alpha epsilon zeta", "delta alpha", "y" * 5000 + " alpha", "zeta " + "y" * 5000) * 3:
        assert list(cache.values([text])) == [len(tok.encode(text, add_special_tokens=False).ids)]
    assert not [w for w in cache.known if len(w) > pretokens.LONGEST and w not in cache.passing]


@pytest.mark.parametrize("entries", [0, 5, token_counts.TABLE_ENTRIES])
def test_token_counts_whatever_the_table(docs, rows, ids, entries):
    got = collected(token_counts.token_counts(docs, TOKENIZER, 10, entries))
    want = sorted(((i, len((r[1] or "").encode()), len(v), len(v) > 10) for r, (i, v) in zip(rows, ids, strict=True)), key=key)
    assert got == want


def test_another_tokenizers_rule_is_its_own(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = collected(token_counts.token_counts(docs, path, 10))
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 10) for r in rows), key=key)
    assert got == want


def test_token_files_round_trip(spark, docs, rows, ids, tmp_path):
    path = token_files.write_token_files(docs, TOKENIZER, str(tmp_path / "t"))
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    order = sorted(zip(rows, ids, strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] or ""))
    start = 0
    for r, (_, (doc_id, v)) in zip(got, order, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(v) + 1, crc([*v, 2]))
        start += len(v) + 1
    assert sum(p.stat().st_size for p in (tmp_path / "t").glob("*.ids")) == 2 * start
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".part")]


def test_packing_is_whole_and_gapless(docs, ids):
    got = packing.pack(docs, TOKENIZER, capacity=64).collect()
    want = collections.Counter((i, len(v) + 1, crc([*v, 1]) if len(v) + 1 < 64 else None) for i, v in ids)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(v) + 1 for _, v in ids)
    assert sum(r.length for r in got) == total and len(sequences) <= 1.01 * total / 64 + 1
    seen = collections.Counter((r.doc_id, r.length, r.ids_crc32) for r in got if r.piece == 0 and r.length < 64)
    assert all(seen[k] == n for k, n in want.items() if k[2] is not None)
    for r in (r for rs in pieces.values() for r in rs):
        assert r.start == 64 * r.piece


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_bin_plan_uses_each_piece_once(counts):
    used = collections.Counter()
    plan = packing.plan_bins(dict(counts), 40)
    for bins, lengths in plan:
        assert sum(length * n for length, n in lengths) <= 40
        for length, n in lengths:
            used[length] += bins * n
    assert used == collections.Counter(counts)
    table = packing.lay_out(plan)
    assert len(table["length"]) == sum(len(lengths) for _, lengths in plan)


def test_two_fit_beats_the_smallest_piece():
    # greedy fills 10 with 6 and 3; 3 gives way to 2 and 2, which fill the gap
    plan = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0][1] == [(6, 1), (2, 2)]


# ---- 3 suffix arrays ------------------------------------------------------------------------------------------------


def brute_substrings(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        covered = np.zeros(len(text) + 1, int)
        for s in range(len(text) - length + 1):
            w = text[s : s + length]
            if w in seen:
                covered[s] += 1
                if s + length <= len(text):
                    covered[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(covered[:-1]) > 0 if len(text) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((doc_id, len(text), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("part", [suffix_dedup.PART, 2])
@pytest.mark.parametrize(("length", "anchor"), [(100, 32), (12, 5)])
def test_suffix_dedup_against_every_string(spark, docs, rows, length, anchor, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    assert collected(suffix_dedup.suffix_dedup(docs, length, anchor)) == brute_substrings(rows, length)


def test_suffix_dedup_unique_ids_and_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcd ") for _ in range(400))
    rows = [(i, ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 900))) + passage * (i % 3 == 0)) * (1 + i % 2)) for i in range(30)] + [(99, "a" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collected(suffix_dedup.suffix_dedup(df)) == brute_substrings(rows, 100)


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=1, max_size=400), st.integers(1, 70))
def test_suffix_groups_sort_like_strings(text, length):
    data = np.frombuffer(text.encode(), np.uint8)
    suffixes = np.arange(max(0, len(data) - length + 1))
    order, group = suffix_dedup.suffix_groups(data, suffixes, length)
    found = [text[i : i + length] for i in order]
    assert found == sorted(found) and sorted(order.tolist()) == suffixes.tolist()
    assert all((a == b) == (g == h) for a, b, g, h in zip(found, found[1:], group, group[1:], strict=False))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=21, max_size=21), min_size=2, max_size=40), st.integers(0, 2), st.integers(17, 21))
def test_blind_tries_order_and_group(strings, depth, length):
    strings = [strings[0][: 8 * depth] + s[8 * depth :] for s in strings]
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    order, new = np.arange(len(strings)) * 21, np.zeros(len(strings), bool)
    new[0] = True
    suffix_dedup.blind_tries(suffix_dedup.characters(data), order, new, np.array([0]), np.array([len(strings)]), depth, length)
    found = [strings[i // 21][:length] for i in order]
    assert found == sorted(found) and new.sum() == len(set(found)) and sorted(order.tolist()) == [21 * i for i in range(len(strings))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab", min_size=20, max_size=20)), min_size=1, max_size=60))
def test_groups_known_before_are_sorted_apart(tagged):
    tagged.sort(key=lambda x: x[0])
    data, group = np.frombuffer("".join(t for _, t in tagged).encode(), np.uint8), np.array([g for g, _ in tagged])
    order, equal = suffix_dedup.suffix_groups(data, np.arange(len(tagged)) * 20, 20, group)
    found = [tagged[i // 20] for i in order]
    assert found == sorted(found) and equal[-1] + 1 == len(set(tagged))


# ---- 4 language -----------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97 and found.score.between(0, 1).all() and not found.rejected.any()
    for r in found.head(20).itertuples():
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2


def test_language_rejects_what_has_no_letters_and_keeps_columns(docs):
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(found[i].lang_pred == "und" and found[i].rejected and found[i].score == 0 for i in (5, 6, 7, 12))
    kept = langid.keep_known(clashing(docs))
    assert kept.columns == clashing(docs).columns and {5, 6, 7, 12}.isdisjoint(r.doc_id for r in kept.collect())


def test_language_rejects_latin_script_that_was_not_learned(spark):
    rng = random.Random(3)
    prose = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván.",
        "Il governo ha annunciato oggi una nuova legge per la protezione dei consumatori", "O governo anunciou hoje uma nova lei para a proteção dos consumidores",
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)),
        "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400)),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    odd = spark.createDataFrame(list(enumerate(t for x in prose for t in (x, 5 * (x + "\n")))), "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(odd, model).collect())
    assert (langid.predict(docs.where(langid.held_out()), model).where("rejected").count()) == 0


def test_language_reach_follows_the_checked_texts():
    """Quantiles of a language's own distances with a margin that shrinks with their number, and no less for shorter texts."""
    last = len(langid.LENGTHS)
    near = [("a", 2, 0.1 + i / 500) for i in range(100)] + [("b", last, 0.7)] * 100 + [("a", 0, 0.2)] * 4
    reach = langid.reaches(near, ["a", "b", "c"])
    b, alone = 0.7 + (0.1 + 0.05) * 0.3, 0.2 + (0.1 + 0.25) * 0.8
    a = langid.LEAST_REACH
    assert np.allclose(reach[0], [max(a, alone), a, a, *[langid.REJECT_BEYOND] * (last - 2)]) and np.allclose(reach[1], b) and np.allclose(reach[2], langid.REJECT_BEYOND)


def test_excerpts_have_every_length_that_a_text_exceeds():
    text = " ".join(["Wörter", "und", "mehr,", "12"] * 300)
    found = langid.excerpts(text)
    data, offsets = textbytes.raw(pa.array([x.lower() for x in found]))
    assert len(found) == len(langid.LENGTHS) and all(f" {x} " in f" {text} " for x in found)
    assert (np.abs(langid.length_class(data, offsets) - np.arange(len(found))) <= 1).all()
    assert langid.excerpts("") == [] and len(langid.excerpts("one two three")) <= 2


def test_language_without_labels_knows_nothing(docs):
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_counts_do_not_cross_texts():
    data, offsets = textbytes.raw(pa.array(["abc", "xyz"]))
    both = langid.counts(data, offsets)
    for i, t in enumerate(("abc", "xyz")):
        assert (both[i] == langid.counts(*textbytes.raw(pa.array([t])))[0]).all()


def test_cosines_are_the_same_whatever_rows_come_along():
    draw = np.random.default_rng(4)
    found = draw.poisson(0.05, (300, langid.DIMENSIONS)).astype(np.float32)
    idf, centroids = draw.uniform(1, 8, langid.DIMENSIONS).astype(np.float32), langid.unit(draw.random((16, langid.DIMENSIONS))).astype(np.float32)
    whole = langid.nearest(found, idf, centroids)
    for n in (1, 3, 7, 64):
        parts = [langid.nearest(found[i : i + n], idf, centroids) for i in range(0, len(found), n)]
        assert all((np.concatenate([p[k] for p in parts]) == whole[k]).all() for k in (0, 1))
    assert np.allclose(whole[1], (langid.vectors(found, idf) @ centroids.T).max(axis=1), atol=1e-5)


# ---- 6 exact dedup --------------------------------------------------------------------------------------------------


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups["".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r")].append(r)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, rows, weak):
    """With a digest of one byte the full bytes decide."""
    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(docs, digest).collect()
    groups = brute_copies(rows)
    assert collections.Counter((r.keep_id, r.group_size) for r in got if r.kept) == collections.Counter(
        (max(g, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0)))[0], len(g)) for g in groups.values()
    )
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_continues_from_its_state(spark, rows, tmp_path, weak):
    """Three calls on one checkpoint: groups hold the rows of all, and texts of different calls that share a digest stay apart."""
    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))) if weak else exact_dedup.sha256
    seen, checkpoint = [], str(tmp_path / "dedup")
    for part in (rows[:20], rows[20:], [(500, None, None, None, 0), (0, "One word", None, None, 8), (501, rows[0][1] + "   ", None, None, 1)]):
        seen += part
        groups = brute_copies(seen)
        best = {k: max(g, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0))) for k, g in groups.items()}
        got = exact_dedup.exact_dedup(spark.createDataFrame(part, SCHEMA), digest, checkpoint).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == collections.Counter(
            (r[0], best[k][0], len(groups[k])) for r in part for k in ["".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r")]
        )
        assert sum(r.kept for r in got) == sum(1 for b in best.values() if any(b is r for r in part))
        assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_exact_dedup_shuffles_many_hits(docs, rows, monkeypatch):
    want = collected(exact_dedup.exact_dedup(docs).drop("digest"))
    monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", 0)
    assert collected(exact_dedup.exact_dedup(docs).drop("digest")) == want


def test_exact_dedup_keeps_whole_rows(docs, rows):
    kept = exact_dedup.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    texts = ["".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r") for r in kept.collect()]
    assert sorted(texts) == sorted(brute_copies(rows))


# ---- 7 mixing -------------------------------------------------------------------------------------------------------


def brute_divide(children, given):
    """Water-filling by repetition: (weight, capacity) -> budget."""
    out, open_ = {k: 0.0 for k in children}, {k for k, (w, c) in children.items() if w > 0 and c > 0}
    while open_ and given > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if out[k] + given * children[k][0] / total >= children[k][1] - 1e-9}
        if not full:
            for k in open_:
                out[k] += given * children[k][0] / total
            break
        share = given
        for k in full:
            more = min(children[k][1] - out[k], share * children[k][0] / total)
            given -= children[k][1] - out[k]
            out[k] = children[k][1]
            assert more >= -1e-6
        open_ -= full
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 200)), min_size=1, max_size=7), st.integers(0, 900))
def test_divide_is_water_filling(spark, children, given_):
    table = spark.createDataFrame([("p", f"c{i}", float(w), c, float(given_)) for i, (w, c) in enumerate(children)], "parent string, child string, w double, capacity long, given double")
    got = {r.child: r.budget for r in mixing.divide(table, ["parent"], "child").collect()}
    want = brute_divide({f"c{i}": x for i, x in enumerate(children)}, float(given_))
    for k, v in want.items():
        assert got.get(k, 0.0) == pytest.approx(v, abs=1e-6)


def test_mix_takes_seeded_prefixes(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 20))), rng.choice(["en", "fr"]), rng.choice(["src0", "src1", "src2"]), 0) for i in range(300)]
    mix = mixing.Mix(lang_weights={"en": 5.0}, share=0.9, max_epochs=3)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(docs, mix).collect()
    budget = {(r.domain, r.lang, r.source): r for r in mixing.budgets(mixing.described(docs, mix).groupBy(*mixing.LEAF).agg(F.sum("n_tokens").alias("tokens")), mix).collect()}
    taken = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in got:
        taken[r.domain, r.lang, r.source][r.epoch].add(r.doc_id)
    size = {r[0]: len(r[1].split()) for r in rows}
    for leaf, b in budget.items():
        own = [r[0] for r in rows if (r[2], r[3]) == leaf[1:]]
        left = b.budget
        for epoch in range(3):
            want = set()
            order = sorted(own, key=lambda i: hashlib.md5(f"17:{epoch}:{i}".encode()).hexdigest())
            used = 0
            for i in order if left >= 0 else []:
                used += size[i]
                if used > left:
                    break
                want.add(i)
            if epoch <= b.budget // b.tokens:
                assert taken[leaf][epoch] == want
            left -= b.tokens
    assert sum(size[r.doc_id] for r in got) <= 0.9 * sum(size.values()) + 1
    copies = collections.Counter(r.doc_id for r in mixing.keep_mixed(docs, mix).collect())
    assert copies == collections.Counter(r.doc_id for r in got)


@pytest.mark.parametrize("stage", [exact_dedup.keep_one, simhash.keep_one, mixing.keep_mixed, langid.keep_known])
def test_stages_keep_any_columns_and_take_empty_tables(stage, docs, empty):
    """Names that the stages use themselves, in any case, a map column, repeated and null doc_ids."""
    odd = docs.select("*", *[F.lit(1).alias(c) for c in ("at", "_AT", "stays", "of", "own", "own_id", "copies", "copy", "__rows", "__id", "row", "batch", "norm", "kept")])
    odd = odd.withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    found = stage(odd)
    assert found.dtypes == odd.dtypes and found.count() == stage(docs).count()
    assert stage(empty).count() == 0 and stage(empty).dtypes == empty.dtypes


@pytest.mark.parametrize("few", [0, 500_000])
def test_stages_keep_the_same_rows_whatever_is_broadcast(docs, few, monkeypatch):
    from tallyglass.llm import common

    unique = docs.where("doc_id IS NOT NULL AND doc_id <> 9")
    want = [collected(stage(unique)) for stage in (exact_dedup.keep_one, simhash.keep_one)]
    monkeypatch.setattr(common, "FEW_ROWS", few)
    monkeypatch.setattr(simhash, "MEMBERS_BROADCAST", few)
    assert [collected(stage(unique)) for stage in (exact_dedup.keep_one, simhash.keep_one)] == want
    tagged = unique.withColumn("doc_id", F.lit(None).cast("long"))  # the same rows, numbered anew
    assert exact_dedup.keep_one(tagged).count() == len(want[0]) and simhash.keep_one(tagged).count() == len(want[1])


def test_keep_mixed_keeps_what_is_taken_of_repeated_ids(spark):
    rng = random.Random(6)
    rows = [(i % 7 if i % 5 else None, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 12))), "en", "src0", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    taken = mixing.mix_sources(docs).collect()
    kept = mixing.keep_mixed(docs).collect()
    assert len(kept) == len(taken) and sum(len(r.text.split()) for r in kept) == sum(r.n_tokens for r in taken)


# ---- 8 SimHash ------------------------------------------------------------------------------------------------------


def brute_simhash(text, size=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(near, ids):
    label = {i: i for i in range(len(ids))}
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(near), strict=True):
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    least = collections.defaultdict(list)
    for i, x in label.items():
        least[x].append(ids[i])
    return [min((v for v in least[label[i]] if v is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("radius", [3, 6])
def test_simhash_and_its_components(docs, rows, radius):
    fp = np.array([brute_simhash(r[1] or "") for r in rows], np.uint64)
    ids = [r[0] for r in rows]
    component = brute_components(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, ids)
    got = simhash.near_duplicates(docs, radius=radius).select("doc_id", simhash.hex_digits().alias("h"), "component_id")
    assert collected(got) == sorted(((i, f"{int(f):016x}", c) for i, f, c in zip(ids, fp, component, strict=True)), key=key)


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, np.uint64)
    own = np.unique(np.concatenate([base, base[:20] ^ np.uint64(1 << 7)]))
    others = np.unique(base[10:] ^ np.uint64(6))
    a, b = simhash.forest(own, others, 3)
    joined = {int(x): int(x) for x in np.concatenate([own, others])}

    def top(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        joined[max(top(x), top(y))] = min(top(x), top(y))
    for x in own.tolist():
        for y in [*own.tolist(), *others.tolist()]:
            if bin(x ^ y).count("1") <= 3:
                assert top(x) == top(y)
    assert len(a) <= len(own) + len(others)


@pytest.mark.parametrize(("block", "slice_"), [(3, 1), (5, 2), (8192, 16)])
def test_links_equal_all_pairs_whatever_the_blocks(spark, block, slice_, monkeypatch):
    """Many fingerprints in one tile and in its neighbours, chains and lone ones."""
    monkeypatch.setattr(simhash, "SLICE", slice_)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 12, np.uint64)
    chain = [b ^ (np.uint64(3) << np.uint64(k)) ^ (np.uint64(1) << np.uint64(j)) for b in base[:4] for k in (0, 20, 40) for j in (5, 9)]
    fps = np.unique(np.concatenate([base, np.array(chain, np.uint64), np.uint64(0xFF) << np.arange(0, 40, dtype=np.uint64)]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    signed = fps.view(np.int64).tolist()
    order = {f: i for i, f in enumerate(sorted(signed))}
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, block)).collect()}
    want = brute_components(near[np.argsort(signed)][:, np.argsort(signed)], list(range(len(fps))))
    assert [order[roots.get(f, f)] for f in sorted(signed)] == want


@pytest.mark.parametrize("slice_", [1, 16])
@pytest.mark.parametrize("tile", [4, 8192])
def test_wide_links_equal_all_pairs(spark, tile, slice_, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", slice_)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (30, 4), np.uint64)
    near = base.copy()
    near[:, 1] ^= np.uint64(0xFFFFF)
    prints = np.concatenate([base, near[:15]])
    fps = spark.createDataFrame([(i, bytes(p.tobytes())) for i, p in enumerate(prints)], "node long, fp binary")
    distance = sum(np.bitwise_count(prints[:, None, w] ^ prints[None, :, w]).astype(int) for w in range(4))
    want = brute_components(distance <= 52, list(range(len(prints))))
    roots = {r.node: r.root for r in components(simhash.wide_links(fps, 52, tile)).collect()}
    assert [roots.get(i, i) for i in range(len(prints))] == want


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(90, 160), st.integers(1, 40), min_size=1, max_size=20), st.integers(1, 50))
def test_tiles_meet_once(counts, tile):
    _, limits = simhash.tile_plan(counts, tile)
    met = collections.Counter(frozenset((t, own)) for own in range(len(limits)) for t in simhash.partners(own, limits, 256))
    assert all(met[frozenset((a, b))] == 1 for a in range(len(limits)) for b in range(a, len(limits))) and sum(met.values()) == len(met)


def test_similar_keeps_one_of_a_group(spark):
    rng = random.Random(7)
    base = [str(rng.randint(0, 999)) for _ in range(200)]
    edit = lambda i: " ".join(base[:i] + ["edited"] + base[i + 1 :])
    rows = [(5, " ".join(base)), (3, edit(50)), (9, edit(120)), (4, " ".join(str(rng.randint(0, 999)) for _ in range(200))), (None, "no id"), (8, ""), (8, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(kept) == sorted([(3, edit(50)), (4, rows[3][1]), (None, "no id"), (8, "")], key=key)


def test_similar_links_what_reaches_the_similarity_and_nothing_else(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 4)  # several blocks a component
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    texts, line = [], " ".join(words(12)) + " "
    for n, tails in ((60, (0, 6, 9, 12, 13, 14, 15, 16, 17, 18, 24)), (300, (0, 30, 50, 65, 70, 75, 80, 90))):  # similarities from 1 to 0.6
        shared = words(n)
        texts += [" ".join(shared + words(t)) for t in tails]
    texts += [line * 40 + " ".join(words(40)) for _ in range(12)]  # a much-repeated line
    texts += ["a b c d e f g h", "a b c d e f g h i", "A  B c d e f g h", "a b c d e f g h j k", "", " ", "one", "two"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    found = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == brute_components(near, list(range(len(texts))))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components_of_any_graph(spark, edges):
    near = np.zeros((13, 13), bool)
    for a, b in edges:
        near[a, b] = near[b, a] = True
    want = brute_components(near, list(range(13)))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} if edges else {}
    assert {i: got.get(i, i) for i in range(13)} == dict(enumerate(want))


# ---- 10 licenses ----------------------------------------------------------------------------------------------------


def test_licenses_found_and_prose_left_alone(spark):
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore."), (2, "Prose. Licensed under the Apache License, Version 2.0. More prose"), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "He had a licence to fish in the river and kept it in a drawer."), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0."),
        (8, "This work is licensed under the GNU Lesser General Public License, version 2.1."), (9, "Released under an MIT License."),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license, r.word_differences) for r in found} == {
        (1, "MIT", 0), (2, "Apache", 0), (3, "GPL", 0), (7, "CC-BY-NC", 0), (7, "CC-BY", 0), (8, "LGPL", 0), (9, "MIT", 1),
    }
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.start + len(r.block)] == r.block and 0 < r.saving < 1 for r in found)


@pytest.mark.parametrize("name", licenses.NOTICES)
def test_notices_in_any_case_and_amid_other_words_are_found(name):
    text, around = licenses.NOTICES[name].replace("{v}", "4.0").rstrip("."), "it was agreed by both of the parties after long talks in the old town hall that"
    for t in (text.upper() + ".", text.lower(), f"{around} {text.lower()} and {around}.", f"{around} {around} {around} {text.lower()}"):
        assert [(h[0], h[4]) for h in licenses.scan_text(t)] == [(name, 0)]
    assert [(h[0], h[4]) for h in licenses.scan_text(f"{text} or, if you like, {around} {text}, or all rights reserved.")].count((name, 0)) == 2 + (name == "Proprietary")


def test_two_licenses_in_a_sentence_are_two():
    text = "Licensed under the Apache License, Version 2.0, or released under the MIT License."
    assert [(h[0], h[1], h[4]) for h in licenses.scan_text(text)] == [("Apache", 0, 0), ("MIT", 0, 0)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), min_size=1, max_size=5))
def test_differences_are_the_least_of_all_stretches(have, want):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    n, begin, end = licenses.differences(have, want)
    assert n == distance(have[begin:end], want) == min(distance(have[i:j], want) for i in range(len(have) + 1) for j in range(i, len(have) + 1))


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
@pytest.mark.parametrize("name", licenses.NOTICES)
def test_wrapped_notices_are_found(name, mark):
    notice = licenses.NOTICES[name].replace("{v}", "4.0").split()
    for width in (2, 7, 9):
        lines = [" ".join(notice[k : k + width]) for k in range(0, len(notice), width)]
        text = f"{mark}Copyright 2020 Some One\n{mark.rstrip()}\n" + "\n".join(mark + x for x in lines) + f"\n{mark.rstrip()}\nimport os\n"
        assert re.search(licenses.MENTION, text)
        hits = licenses.scan_text(text)
        assert [(h[0], h[4]) for h in hits] == [(name, 0)]
        assert all(text[h[1] : h[1] + len(h[2])] == h[2] for h in hits)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
@pytest.mark.parametrize("name", licenses.TEXTS)
def test_whole_texts_are_found_however_wrapped(name, mark):
    """Every license text at several line widths behind every comment mark, blank lines between its sentences, some words changed."""
    notice = re.sub(r"(?<=[a-z:])\n", "\n\n", licenses.TEXTS[name].replace("{v}", "2.0"))
    for width in (48, 72, 80):
        lines = [x for part in notice.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
        text = f"{mark}Copyright 2020 Some One\n{mark.rstrip()}\n" + "\n".join((mark + x).rstrip() for x in lines) + "\nimport os\n\ndef main(): pass\n"
        hits = licenses.scan_text(text)
        assert [(h[0], h[4]) for h in hits] == [(name, 0)]
        assert all(text[h[1] : h[1] + len(h[2])] == h[2] and 0.3 < h[3] < 1 for h in hits)
        edited = text.replace("software", "work").replace("IMPLIED", "TACIT")
        assert [h[0] for h in licenses.scan_text(edited)][:1] == [name]


def test_whole_texts_against_all_stretches(monkeypatch):
    """The seeds lose no stretch: against every stretch of made-up documents, with templates of few words."""
    monkeypatch.setattr(licenses, "SEED_WORDS", 3)
    rng = random.Random(12)
    template = {"T-text": "license " + " ".join(rng.choice("abcdefgh") for _ in range(15))}
    want = licenses.words(template["T-text"])
    for _ in range(40):
        core = [w if rng.random() > 0.15 else rng.choice(["x", "x y", ""]) for w in want]
        have = " ".join([rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] + core + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]).split()
        best = licenses.differences(have, want)[0]
        found = [n for _, n, _, _ in licenses.whole_texts(" ".join(have), template)]
        assert min(found, default=99) == best if best <= 4 else not found


def test_what_is_denied_is_no_notice():
    assert licenses.scan_text("Not all rights reserved.") == []
    assert [h[0] for h in licenses.scan_text("// SPDX-License-Identifier: MIT\nint x;")] == ["SPDX-MIT"]
    assert [h[0] for h in licenses.scan_text("/* SPDX-License-Identifier: GPL-2.0-only */")] == ["SPDX-GPL-2.0-only"]


@pytest.mark.parametrize("name", licenses.NOTICES)
def test_each_notice_is_its_own_best(name):
    text = licenses.NOTICES[name].replace("{v}", "4.0")
    hits = licenses.scan_text("Before it. " + text + " After it.")
    assert name in {h[0] for h in hits} and all(h[4] == 0 for h in hits if h[0] == name)


# ---- shared ---------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(" ab\nß\x0b", max_size=30), max_size=8), st.integers(1, 6))
def test_shingle_hashes_follow_the_words(texts, size):
    raw = [t.encode() for t in texts]
    data, offsets = textbytes.raw(pa.array(raw, pa.binary()))
    h, owner = textbytes.shingle_hashes(data, offsets, size)
    want = collections.Counter((i, tuple(w[k : k + size])) for i, t in enumerate(raw) if (w := t.split()) for k in range(max(1, len(w) - size + 1)))
    seen = collections.defaultdict(set)
    assert collections.Counter(owner.tolist()) == collections.Counter(i for i, _ in want.elements())
    for i, _ in enumerate(raw):
        seen[i] = sorted(collections.Counter(h[owner == i].tolist()).values())
        assert seen[i] == sorted(n for (j, _), n in want.items() if j == i)


def test_written_tables_read_back(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert collected(materialize(df, "t")) == collected(df)
