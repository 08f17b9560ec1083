"""The corpus operators over the given tables, and their expected answers in SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (divergence, line_dedup, mixing, near_dup, neighbours, packing, personal, prefix_trie, quality,
               substrings, token_counts, toxicity, windows)
from .common import documents, read, stored, text_of, words


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(documents(spark, sf_dir)).select(
        "doc_id", "source", "n_lines", "n_dropped", "text")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(documents(spark, sf_dir).select("doc_id", "text"),
                           read(spark, sf_dir, "labels")).drop("text")


def op4_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.shared(documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.group(documents(spark, sf_dir).select("doc_id", "text"),
                          near_dup.Rule(words=3, part=85)).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(documents(spark, sf_dir).select("doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.found(documents(spark, sf_dir).select("doc_id", "text")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stored(documents(spark, sf_dir).select(
        "source", "doc_id", F.size(words(text_of())).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("digest")), "sizes")
    return mixing.copies_of_documents(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir).select("doc_id", "text"),
                          read(spark, sf_dir, "labels")).drop("text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir).select("text", "lang", "source"))


def op12_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_in_order(documents(spark, sf_dir).select("doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_nearest_neighbours, op3_toxicity, op4_shared_passages, op5_near_duplicates,
    op6_token_counts, op7_best_fit_packing, op8_personal_data, op9_source_mixing, op10_quality,
    op11_source_divergence, op12_ordered_packing, op13_prefix_trie)}

ORACLES = {
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
        bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS b FROM lines),
        common AS (
            SELECT source, b FROM bare WHERE b <> '' GROUP BY source, b
            HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_PAGES} AND count(DISTINCT doc_id) >= {line_dedup.RATIO}
                * (SELECT count(*) FROM documents d WHERE d.source = bare.source)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS text
                 FROM bare WHERE (source, b) NOT IN (SELECT source, b FROM common) GROUP BY doc_id)
        SELECT d.doc_id, d.source, len(string_split(d.text, chr(10))) AS n_lines,
               len(string_split(d.text, chr(10))) - coalesce(n, 0) AS n_dropped, coalesce(kept.text, '') AS text
        FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op11_source_divergence": rf"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        w AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        groups AS (SELECT DISTINCT lang, source FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.LEAST}),
        langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
        held AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
        cells AS (SELECT lang, source, term, total, coalesce(held.n, 0)::HUGEINT AS n
                  FROM groups JOIN kept USING (lang) LEFT JOIN held USING (lang, source, term)),
        p AS (SELECT lang, source, term, c.n,
                     1 + 1000000000::HUGEINT * (c.n + 5) // (sum(c.n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p,
                     1 + 1000000000::HUGEINT * (total + 5) // (l.n + 5 * v) AS q
              FROM cells c JOIN langs l USING (lang)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
                  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.LISTED}""",
    "op13_prefix_trie": """
        WITH RECURSIVE own AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                FROM conversations WHERE conv_id IS NOT NULL)),
        ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM own),
        crc AS (
            SELECT conv_id, s, 0 AS k, 4294967295::BIGINT AS v FROM ids
            UNION ALL
            SELECT conv_id, s, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END FROM (
                SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE v END AS x
                FROM crc WHERE k < 8 * length(s))),
        heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(v, 4294967295::BIGINT) % 9 AS h
                  FROM crc WHERE k = 8 * length(s)),
        made AS (
            SELECT heads.conv_id, 0 AS part, place, role, text FROM heads JOIN own ON own.conv_id = base AND place <= h
            UNION ALL SELECT conv_id, 1, place, role, text FROM heads JOIN own USING (conv_id) WHERE place > h),
        paths AS (
            SELECT conv_id, coalesce(list(strlen(role) || ':' || role || text ORDER BY part, place) FILTER (part IS NOT NULL), []) AS path,
                   coalesce(list(strlen(text) ORDER BY part, place) FILTER (part IS NOT NULL), []) AS sizes
            FROM heads LEFT JOIN made USING (conv_id) GROUP BY conv_id),
        prefixes AS (SELECT conv_id, path, sizes, unnest(range(0, len(path) + 1)) AS depth FROM paths),
        nodes AS (
            SELECT path[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   (count(*) - 1) * coalesce(max(sizes[depth]), 0) AS saved,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
            FROM prefixes GROUP BY 1, 2),
        below AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN below USING (p)),
        up AS (SELECT p[1:k] AS p, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (
            SELECT p, saved, (n_children = 0)::INT AS leaf, unnest(range(0, depth + 1)) AS k FROM full_nodes) GROUP BY 1)
        SELECT n.conv_id, n.depth, parent.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM full_nodes n JOIN up USING (p) LEFT JOIN nodes parent ON n.depth > 0 AND parent.p = n.p[1:n.depth - 1]""",
}
