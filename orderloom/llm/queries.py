"""The operators' registered queries, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from orderloom.llm import bpe, lm, quality
from orderloom.llm.ann import nearest
from orderloom.llm.common import fold
from orderloom.llm.decontaminate import contaminated
from orderloom.llm.html_text import extract_text
from orderloom.llm.jaccard import similar_groups
from orderloom.llm.pii import pseudonymise
from orderloom.llm.repeats import without_repeats
from orderloom.llm.spelling import spelling_groups
from orderloom.llm.token_counts import count_tokens
from orderloom.llm.warc import round_trip
from orderloom.llm.whitening import whitened

PII_KEY = b"orderloom: replace by a secret key"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "pages"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonymise(docs, PII_KEY)


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(table(spark, folder, "documents"))


def op13_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_lm": op2_lm,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_main_text": op5_main_text,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_neighbours": op8_neighbours,
    "op9_jaccard": op9_jaccard,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_repeats": op13_repeats,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
        SELECT p.page_id, strlen(p.payload) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::BIGINT, 5))::BIGINT >> (5 * (3 - i % 4))::BIGINT) & 31), 1)), '')
                AS payload_digest,
            CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
        FROM p JOIN f USING (payload)
    """,
    "op9_jaccard": """
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), sets AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
                THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
            FROM split
        ), sizes AS (
            SELECT d.doc_id, count(s.shingle) AS n FROM documents d LEFT JOIN sets s USING (doc_id) GROUP BY 1
        ), meets AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
            FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM meets JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * shared >= 75 * (p.n + q.n - shared)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
        )
        SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id,
            (SELECT count(*) FROM links WHERE x = s.doc_id) AS n_links
        FROM sizes s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n
    """,
    "op12_spelling": """
        WITH RECURSIVE tbl AS (
            SELECT list_transform(range(256), lambda b: list_reduce(
                list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
        ), runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS name, translate(unnest(regexp_extract_all(coalesce(text, ''),
                '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents
        ), counted AS (
            SELECT run, name, hex(encode(name || ':' || run)) AS x, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY 1, 2
        ), hashed AS (
            SELECT run, k, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(length(x) // 2),
                    lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) AS h
            FROM counted, tbl
        ), words AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
                sum(k)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING sum(k) >= 2 AND length(word) >= 7
        ), cuts AS (
            SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r
            FROM words, unnest(range(1, 1 + length(word))) AS u(i)
        ), near AS (
            SELECT a.word AS a, b.word AS b, b.n AS n FROM cuts a JOIN cuts b ON a.l = b.l AND a.r = b.r AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.l || c.r
            UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.l || c.r
        ), best AS (
            SELECT a, count(*) AS n_near, max(n) AS top, min(CASE WHEN n = m THEN b END) AS b
            FROM (SELECT *, max(n) OVER (PARTITION BY a) AS m FROM near) GROUP BY a
        ), formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN b END AS form,
                CASE WHEN top >= 10 * n THEN top END AS form_n
            FROM words LEFT JOIN best ON a = word
        ), chain(word, root) AS (
            SELECT word, word FROM formed
            UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
        FROM formed f JOIN chain c ON c.word = f.word JOIN formed g ON g.word = c.root AND g.form IS NULL
    """,
    "op13_repeats": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
        ), blocks AS (
            SELECT doc_id, o, substr(x, 2 * o + 1, 2198) AS y FROM d, unnest(range(0, n, 1000)) AS u(o)
        ), windows AS (
            SELECT doc_id, o + i AS i, substr(y, 2 * i + 1, 200) AS w
            FROM blocks, unnest(range(least(1000, length(y) // 2 - 99))) AS u(i)
        ), repeats AS (
            SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
            FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
        ), spans AS (
            SELECT doc_id, min(i) AS a, max(i) + 100 AS b
            FROM (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM repeats)
            GROUP BY doc_id, g
        ), pieces AS (
            SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS open FROM spans
        ), found AS (
            SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS b,
                string_agg(substr(x, 2 * open + 1, 2 * (a - open)), '' ORDER BY a) AS kept
            FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN found USING (doc_id)
    """,
}
