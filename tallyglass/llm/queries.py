"""The operators of this package as registered queries, each over its whole table, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import conversations, exact_dedup, fim, langid, licenses, minhash, mixing, packing, simhash, suffix_dedup, token_counts, token_files, warc
from tallyglass.llm.common import importable

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Production weights: two domains and one language above the rest, one source above its siblings.
MIX = mixing.Mix(domain_weights={"d0": 4.0, "d1": 2.0}, lang_weights={"en": 3.0}, source_weights={"src0": 2.0})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_neighbours(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(spark, token_files.write_token_files(documents(spark, sf_dir), tokenizer()))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir), MIX)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer(), TOKEN_LIMIT)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    folder = warc.write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.page_records(warc.read_packages(warc.packages(spark, folder), payload=False))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(documents(spark, sf_dir))
    text = fim.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repairs(conversations.damaged(rows), rows)


OPERATORS = (
    op1_fingerprints,
    op2_token_files,
    op3_suffix_dedup,
    op4_language_id,
    op5_packing,
    op6_exact_dedup,
    op7_mixing,
    op8_simhash,
    op9_token_counts,
    op10_licenses,
    op11_warc,
    op12_fill_in_middle,
    op13_conversation_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def _divided(table: str, parent: str, child: str, out: str) -> str:
    """DuckDB text that divides `given` of each parent among its children, as mixing.divide does."""
    at = f"(PARTITION BY {parent} ORDER BY capacity / w, {child} ROWS BETWEEN"
    return f"""
            {out}_a AS (SELECT *, given - coalesce(sum(capacity) OVER {at} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
                sum(w) OVER {at} CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {table} WHERE w > 0 AND capacity > 0),
            {out} AS (SELECT *, CASE WHEN capacity * ws <= lft * w THEN capacity::DOUBLE
                ELSE w * max(CASE WHEN capacity * ws > lft * w THEN lft / ws END) OVER (PARTITION BY {parent}) END AS budget FROM {out}_a),"""


MIXING_SQL = rf"""
            WITH t AS (SELECT doc_id, 'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT % 4) AS domain, coalesce(lang, '') AS lang,
                coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS ident, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
            leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2.0::DOUBLE * sum(n_tokens)::BIGINT AS capacity,
                CASE source WHEN 'src0' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM t GROUP BY ALL),
            d0 AS (SELECT domain, 0 AS tree, sum(capacity) AS capacity, CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
                (SELECT sum(tokens) FROM leaf)::DOUBLE * 0.7::DOUBLE AS given FROM leaf GROUP BY domain),{_divided("d0", "tree", "domain", "dom")}
            l0 AS (SELECT leaf.domain, leaf.lang, sum(leaf.capacity) AS capacity, CASE leaf.lang WHEN 'en' THEN 3.0 ELSE 1.0 END::DOUBLE AS w,
                any_value(dom.budget) AS given FROM leaf JOIN dom USING (domain) GROUP BY leaf.domain, leaf.lang),{_divided("l0", "domain", "lang", "lng")}
            s0 AS (SELECT leaf.*, lng.budget AS given FROM leaf JOIN lng USING (domain, lang)),{_divided("s0", "domain, lang", "source", "src")}
            e AS (SELECT domain, lang, source, epoch, least(tokens, floor(budget + 1e-6)::BIGINT - epoch * tokens) AS room
                FROM src, (SELECT unnest([0, 1]) AS epoch) WHERE epoch <= least(floor(floor(budget + 1e-6) / tokens), 1)),
            k AS (SELECT t.*, epoch, room, md5('17:' || epoch || ':' || ident) AS k FROM t JOIN e USING (domain, lang, source)),
            r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY k, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM k)
            SELECT doc_id, domain, lang, source, n_tokens, epoch FROM r WHERE upto <= room"""


FIM_SQL = r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
            d AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
                CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                    WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
            p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
                array_to_string(u[greatest(a, b) + 1:n], '') AS suf FROM d)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
                sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
                sha256(text) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
            d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to FROM f""",
        "op12_fill_in_middle": FIM_SQL,
        "op7_mixing": MIXING_SQL,
        "op6_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
            g AS (SELECT norm, count(*) AS group_size, arg_max(doc_id, (n, -doc_id)) AS keep_id FROM d GROUP BY norm)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
    }
