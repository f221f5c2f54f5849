"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import decontamination, exact_dedup, license_scan, near_dedup, packing, secret_scan, substring_dedup, toxicity, url_filter, warc
from strandmill.llm.common import table
from strandmill.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_report(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added=True)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each removed stretch."""
    found = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "first_doc_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = (
    op1_secret_scan,
    op2_decontamination,
    op3_toxicity,
    op4_warc_audit,
    op5_packing,
    op6_exact_dedup,
    op7_substring_dedup,
    op8_license_scan,
    op9_simhash_near_dedup,
    op10_url_filter,
)


def queries() -> dict[str, Query]:
    return {q.__name__: _shipped(q) for q in QUERIES}


def _secret_sql() -> str:
    """Matches of every rule by string functions over whole texts, without any index."""
    parts, empty = [], "CAST([] AS STRUCT(s BIGINT, o INT, e BIGINT, k VARCHAR)[])"
    for order, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""CASE WHEN regexp_matches(t, '{pattern}') THEN list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}', 0)) + 1), lambda i: CASE
              WHEN length(regexp_extract_all(t, '{pattern}', {rule.group})[i]) >= {rule.least} THEN
                {{'s': CAST(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}', 0)[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
                  'o': {order}, 'e': CAST(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, '{pattern}', 0)[1:i], lambda x: length(x))) AS BIGINT), 'k': '{rule.kind}'}}
              END), lambda x: x IS NOT NULL) ELSE {empty} END""")
    text = lambda spans: f"array_to_string(list_transform({spans}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda x: x.o = {k})) AS BIGINT) AS n_{secret_scan.RULES[k].kind}" for k in range(3))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS (SELECT doc_id, list_sort(flatten([{", ".join(parts)}])) AS spans FROM d)
        SELECT doc_id, {counts}, sha256(coalesce({text("list_filter(spans, lambda x: x.o < 3)")}, '')) AS base_sha256, coalesce({text("spans")}, '') AS spans FROM f
    """


ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": _secret_sql(),
    "op4_warc_audit": """
        WITH r AS (
          SELECT page_id, CAST(floor(page_id / 512.0) AS BIGINT) AS archive,
                 encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                   || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                   || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
                   || 'Content-Type: text/html' || chr(13) || chr(10)
                   || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
                   || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS rec,
                 encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                   || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                   || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
                   || 'Content-Type: text/html' || chr(13) || chr(10)
                   || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
                   || left(coalesce(html, ''), greatest(length(coalesce(html, '')) - 1, 0)) || '?'
                   || chr(13) || chr(10) || chr(13) || chr(10)) AS bad
          FROM pages),
        -- crc32 by the bitwise definition over the decimal digits of page_id
        c AS (
          SELECT page_id, list_reduce(
                   list_prepend(4294967295::BIGINT, list_transform(string_split(page_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                   lambda acc, d: list_reduce(list_prepend(xor(acc, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                     lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
          FROM pages)
        SELECT r.page_id, archive,
               CAST(coalesce(sum(octet_length(rec)) OVER (PARTITION BY archive ORDER BY r.page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
               CAST(octet_length(rec) AS BIGINT) AS length, sha256(rec) AS sha256, sha256(bad) AS replica_sha256, 'changed' AS status
        FROM r JOIN c ON r.page_id = c.page_id
        QUALIFY xor(crc, 4294967295) % 101 = 0
    """,
    "op6_exact_dedup": """
        WITH n AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
