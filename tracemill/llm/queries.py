"""The registered queries of the operators, and their SQL where SQL can say it.

Digests are much smaller than the texts they stand for; ``rebalance`` keeps them from being a small file per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.bitplanes import CENTROIDS, ROUNDS, SCALE, SEED, cluster_vectors
from tracemill.llm.bpe import decode, encode
from tracemill.llm.filters import filter_audit
from tracemill.llm.fixity import audit, damaged, warc_records
from tracemill.llm.packing import pack_documents
from tracemill.llm.pii import BASE, find_pii, span_text
from tracemill.llm.quality import score_quality
from tracemill.llm.radix import exact_groups
from tracemill.llm.simhash import simhash_groups
from tracemill.llm.substrings import dedup_substrings
from tracemill.llm.tiles import embedding_groups
from tracemill.llm.token_files import document_tokens
from tracemill.llm.vptree import nearest

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(_table(spark, sf_dir, "documents"))).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ).hint("rebalance")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(_table(spark, sf_dir, "documents"))


def op7_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    ).hint("rebalance")


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as records of an archive, against a replica in which some are damaged."""
    pages = _table(spark, sf_dir, "pages")
    found = audit(warc_records(pages), warc_records(damaged(pages)))
    # -1 and the empty text stand for a record that is not there
    return found.fillna(-1).fillna("")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter(F.col("base"), lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_vptree": op1_vptree,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_tokens": op6_tokens,
    "op7_tiles": op7_tiles,
    "op8_substrings": op8_substrings,
    "op9_fixity": op9_fixity,
    "op10_pii": op10_pii,
    "op11_filters": op11_filters,
    "op12_planes": op12_planes,
    "op13_radix": op13_radix,
}


def _clustering() -> str:
    """The rounds written out one after another; ``c<r>`` has the components of the centroids after round r."""
    # Division that rounds down.
    floored = "((total - ((total % n) + n) % n) // n)::BIGINT"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
        d{r} AS MATERIALIZED (
            SELECT x.row, c.k, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c USING (j) GROUP BY x.row, c.k
        ), a{r} AS MATERIALIZED (
            SELECT row, (min((d, k)))[1] AS d, (min((d, k)))[2] AS k FROM d{r} GROUP BY row
        )""")
        if r < ROUNDS:
            steps.append(f"""
        m{r} AS (
            SELECT a.k, x.j, sum(x.v)::HUGEINT AS total, count(*) AS n FROM a{r} a JOIN x USING (row) GROUP BY a.k, x.j
        ), c{r + 1} AS MATERIALIZED (
            SELECT c.k, c.j, coalesce({floored}, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k AND c.j = m.j
        )""")
    return f"""
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
        ), kept AS MATERIALIZED (
            SELECT vec_id, v::BIGINT[] AS v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v::BIGINT[]) AS row
            FROM whole WHERE len(list_filter(v, lambda e: abs(e) >= 134217728)) = 0
        ), x AS MATERIALIZED (
            SELECT row, unnest(v) AS v, unnest(range(64)) AS j FROM kept
        ), c0 AS MATERIALIZED (
            SELECT row - 1 AS k, j, v FROM x WHERE row <= {CENTROIDS}
        ), {",".join(steps)}, names AS (
            SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k
        )
        SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
            (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{ROUNDS} JOIN kept USING (row) JOIN names USING (k)
    """


ORACLE_SQL: dict[str, str] = {
    "op9_fixity": """
        WITH copies AS (
            SELECT 1 AS replica, page_id, url, html FROM pages
            UNION ALL
            SELECT 2, page_id, url, CASE page_id % 97
                WHEN 1 THEN left(html, length(html) // 2) || '~' || substr(html, length(html) // 2 + 2)
                WHEN 2 THEN left(html, length(html) - 1)
                ELSE html END
            FROM pages WHERE page_id % 97 <> 3
        ), records AS (
            SELECT replica, page_id, 'WARC/1.0' || chr(13) || chr(10)
                || 'WARC-Type: response' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
                || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM copies WHERE page_id IS NOT NULL
        ), placed AS (
            SELECT replica, page_id, page_id // 4096 AS file, strlen(record) AS length, sha256(record) AS digest,
                (sum(strlen(record)) OVER (PARTITION BY replica, page_id // 4096 ORDER BY page_id) - strlen(record))::BIGINT
                    AS "offset"
            FROM records
        )
        SELECT coalesce(a.page_id, b.page_id) AS record_key, coalesce(a.file, b.file) AS file,
            coalesce(a."offset", -1) AS "offset", coalesce(a.length, -1) AS length, coalesce(a.digest, '') AS digest,
            coalesce(b."offset", -1) AS offset_2, coalesce(b.length, -1) AS length_2, coalesce(b.digest, '') AS digest_2,
            CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'changed' END AS status
        FROM (SELECT * FROM placed WHERE replica = 1) a
        FULL JOIN (SELECT * FROM placed WHERE replica = 2) b ON a.page_id = b.page_id
        WHERE a.digest IS DISTINCT FROM b.digest
    """,
    "op11_filters": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), marked AS (
            SELECT part, (len(words) < 50)::INTEGER
                + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INTEGER
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INTEGER
                + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER
                + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INTEGER AS mask,
                coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM docs LEFT JOIN (
                SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
                FROM labels GROUP BY doc_id
            ) USING (doc_id)
        ), cells AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM marked GROUP BY part, mask
        ), letters AS (
            SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)
        ), orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ), steps AS (
            SELECT filter_order, step::INTEGER AS step, l.bit,
                (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE instr(substr(filter_order, 1, step - 1), p.letter) > 0)::INTEGER AS before
            FROM orders, range(1, 6) s(step) JOIN letters l ON l.letter = substr(filter_order, step, 1)
        ), found AS (
            SELECT part, filter_order, step, bit,
                coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
                coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
            FROM cells, steps GROUP BY part, filter_order, step, bit
        )
        SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found
    """,
    "op12_planes": _clustering(),
    "op13_radix": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
            doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
    """,
}
