"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, embedding, html_extract, negatives, pii, quality, secrets, simhash, substrings, trie, warc
from tidemark.llm.common import table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of encoded lengths with the suffix sums for every context limit."""
    return bpe.length_table(table(bpe.length_histogram(bpe.token_counts(_table(spark, sf_dir, "documents")))))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans by kind, added kinds and their scores."""
    return pii.digest(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a near copy of it, with the best window's similarity."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without repeated 200-byte strings."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of vectors at cosine 0.95 or more, and the smallest vector that links lead to."""
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score by the compression classifier, fit on rows that are not held out."""
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit(documents, _table(spark, sf_dir, "labels"))
    rows = documents.select("doc_id", "text", quality.held_out("doc_id").alias("held_out"))
    return quality.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories are source and language together, owners the sources."""
    return secrets.digest(_table(spark, sf_dir, "documents"), repo=F.concat_ws("/", "source", "lang"), owner="source")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and the smallest document that links of 4 bits lead to."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text's ids and of what they decode to."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are vectors whose id is divisible by 100; where it is divisible by 7 the label moves on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), "id % 100 = 0")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of archives that are written and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that are rebuilt on the first turns of their family's first."""
    return trie.shared_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_pii, op3_decontamination, op4_substring_dedup, op5_embedding_dedup, op6_quality, op7_secrets, op8_simhash, op9_html, op10_bpe, op11_hard_negatives, op12_warc, op13_prefix_trie)}
#: Links of vectors are all pairs, then the smallest vector that links lead to. Tries are lists of turns' digests and all their
#: prefixes; crc32 is spelled out there, which DuckDB lacks.
ORACLES: dict[str, str] = {
    "op5_embedding_dedup": """
        WITH RECURSIVE ok AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
        FROM embeddings e LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id""",
    "op11_hard_negatives": """
        WITH ok AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]), 0) AS BIGINT) AS s
            FROM ok a JOIN ok b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
        positives AS (SELECT a, b, s FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
        FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s
        QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 5""",
    "op12_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h, n) END AS last FROM d)
        SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM m""",
    "op13_prefix_trie": """
        WITH turns AS (
            SELECT conv_id AS c, turn, coalesce(text, '') AS text, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS whole FROM conversations WHERE conv_id IS NOT NULL),
        placed AS (SELECT *, substr(sha256(whole), 1, 32) AS d, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, substr(sha256(whole), 1, 32)) AS i FROM turns),
        convs AS (
            SELECT c, c - c % 100 AS base, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')],
                lambda r, byte: list_reduce([xor(r, byte)] || CAST(range(8) AS BIGINT[]), lambda z, k: xor(z >> 1, (z & 1) * 3988292384))), CAST(4294967295 AS BIGINT)) % 6 AS h FROM (SELECT DISTINCT c FROM turns)),
        rebuilt AS (
            SELECT k.c, 0 AS own, p.i, p.d, p.text FROM convs k JOIN placed p ON p.c = k.base AND p.i <= k.h
            UNION ALL SELECT k.c, 1, p.i, p.d, p.text FROM convs k JOIN placed p ON p.c = k.c AND p.i > k.h),
        steps AS (SELECT c, row_number() OVER w AS depth, string_agg(d, '') OVER w AS path, length(text) AS chars FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, i)),
        prefixes AS (SELECT c, 0 AS depth, '' AS path, 0 AS chars FROM convs UNION ALL SELECT c, depth, sha256(path), chars FROM steps),
        nodes AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n, min(chars) AS chars FROM prefixes GROUP BY depth, path),
        up AS (SELECT s.c, s.depth, s.path, p.path AS parent FROM prefixes s JOIN prefixes p ON p.c = s.c AND p.depth = s.depth - 1),
        parents AS (SELECT DISTINCT path, parent FROM up),
        children AS (SELECT parent AS path, count(*) AS n_children FROM parents GROUP BY parent),
        own AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, q.parent FROM nodes n LEFT JOIN children k USING (path) LEFT JOIN parents q USING (path)),
        ancestors AS (SELECT DISTINCT a.path AS path, b.path AS under FROM prefixes a JOIN prefixes b ON a.c = b.c AND b.depth >= a.depth),
        totals AS (SELECT a.path, CAST(sum((o.n - 1) * o.chars) AS BIGINT) AS saved, count(*) FILTER (o.n_children = 0) AS leaves FROM ancestors a JOIN own o ON o.path = a.under GROUP BY a.path),
        ends AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h FROM (SELECT c, path FROM prefixes QUALIFY row_number() OVER (PARTITION BY c ORDER BY depth DESC) = 1) GROUP BY path)
        SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, o.n AS n_convs, o.n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
        FROM own o JOIN totals t ON t.path = o.path LEFT JOIN own u ON u.path = o.parent LEFT JOIN ends e ON e.path = o.path""",
}
