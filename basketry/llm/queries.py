"""Registered queries of the training-data operators. Each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from basketry.llm import alignment, decontam, gridjoin, lines, minhash, packing, quality, search, sharding, substring, suffix, topk, toxicity
from basketry.llm.common import table, tokenizer_path
from basketry.llm.labelled import remainder


def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.kept_bytes(suffix.repeated_bytes(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup(table(spark, sf_dir, "documents")))


def op5_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_trie_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: remainder(doc_id, 5) != 0)
    return quality.predictions(scores, 5, 0)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.kept_words(substring.repeated_passages(table(spark, sf_dir, "documents")))


def op10_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: remainder(doc_id, 3) != 1)
    return quality.predictions(scores, 3, 1)


def op11_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_cgk_decontamination": op1_cgk_decontamination,
    "op2_segment_topk": op2_segment_topk,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_balanced_sharding": op5_balanced_sharding,
    "op6_trie_toxicity": op6_trie_toxicity,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_bm25_packing": op8_bm25_packing,
    "op9_super_kmer_dedup": op9_super_kmer_dedup,
    "op10_neighbour_quality": op10_neighbour_quality,
    "op11_epsilon_grid_join": op11_epsilon_grid_join,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE: dict[str, str] = {
    "op2_segment_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND coalesce(list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]), true)
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op4_line_dedup": """
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL
        ), every AS (
            SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
        ), full_lines AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM every WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]')
        ), pairs AS (
            SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS next FROM full_lines
        ), copies AS (
            SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) AS nth,
                CASE WHEN next IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY line, next ORDER BY doc_id, seq) END AS nth_pair
            FROM pairs
        ), marked AS (
            SELECT *, (nth > 1 AND length(line) >= 40) OR nth_pair > 1
                OR coalesce(lag(nth_pair) OVER (PARTITION BY doc_id ORDER BY seq), 1) > 1 AS gone
            FROM copies
        ), runs AS (
            SELECT doc_id, pos, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY seq), false) AS begins FROM marked
        )
        SELECT e.doc_id, count(r.pos) AS n_lines, count(*) FILTER (r.gone) AS n_removed, count(*) FILTER (r.begins) AS n_runs,
            sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (coalesce(NOT r.gone, true)), '')) AS kept_sha256
        FROM every e LEFT JOIN runs r ON e.doc_id = r.doc_id AND e.pos = r.pos GROUP BY e.doc_id""",
    "op11_epsilon_grid_join": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
                label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding])
                    AND list_bool_or([coalesce(x <> 0, false) FOR x IN embedding]) AS usable
            FROM embeddings WHERE vec_id IS NOT NULL
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
                ON x.usable AND y.usable AND x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
            WHERE list_cosine_similarity(x.e, y.e) >= 0.93
        ), reached AS (
            SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        )
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = v.vec_id""",
    "op13_ranked_search": r"""
        WITH lower_docs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents WHERE doc_id IS NOT NULL
        ), tf AS (
            SELECT doc_id, term, count(*) AS tf FROM lower_docs GROUP BY ALL
        ), lengths AS (
            SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
        ), corpus AS (
            SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, big_n
        ), factors AS (
            SELECT doc_id, 100 - 50 + (50 * n * big_n) // big_l AS m FROM lengths, corpus
        ), item_terms AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE item_id IS NOT NULL
        ), scores AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM item_terms JOIN tf USING (term) JOIN weights USING (term) JOIN factors USING (doc_id) GROUP BY item_id, doc_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
