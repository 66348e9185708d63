"""The registered queries of the text operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causalspark.llm.chat import CONTROL, END, START, format_digests, with_probe
from causalspark.llm.decontaminate import decontaminate
from causalspark.llm.edited_counts import edited_counts
from causalspark.llm.exact_dedup import exact_dedup
from causalspark.llm.frames import table
from causalspark.llm.licenses import LEAST_SHARE, TEMPLATES, scan_licenses
from causalspark.llm.lexical_search import TOP, search
from causalspark.llm.neural_lm import lm_scores
from causalspark.llm.packing import packed_rows
from causalspark.llm.pii import pii_spans
from causalspark.llm.prefix_trie import conversation_trie
from causalspark.llm.quality import quality_scores
from causalspark.llm.sentencepiece_fst import encode_decode
from causalspark.llm.simhash_dedup import simhash_dedup


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_digests(with_probe(table(spark, sf_dir, "conversations")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("source", "position")


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


#: Words as the operators take them: A-Z to lower case, runs of digits, letters and all beyond ASCII.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(column: str, text: str) -> str:
    return f"(len({column}) - len(replace({column}, {_quote(text)}, ''))) // {len(text)}"


def _escaped(column: str) -> str:
    """Length of a text after escaping: a backslash more for each backslash and control string."""
    return f"len({column}) + " + " + ".join(_count(column, c) for c in ["\\", *CONTROL])


_TEMPLATES = " UNION ALL ".join(
    f"SELECT {n} AS t, {_quote(t.label)} AS label, {t.base} AS base, {t.words!r} AS tw, {t.must!r} AS must" for n, t in enumerate(TEMPLATES))

_SQL = {
    "op1_license_scan": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        t AS ({_TEMPLATES}),
        places AS (SELECT r, w, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
        starts AS (SELECT r, w, t.*, p - must[1] AS s FROM places JOIN t ON word = tw[must[1] + 1]),
        found AS MATERIALIZED (SELECT r, label, base, s, share FROM (
            SELECT *, CAST(len(list_filter(range(0, len(tw)), lambda j: s + j >= 0 AND w[s + j + 1] IS NOT DISTINCT FROM tw[j + 1])) AS DOUBLE) / len(tw) AS share FROM starts
            WHERE len(list_filter(must, lambda j: w[s + j + 1] IS DISTINCT FROM tw[j + 1])) = 0) WHERE share >= {LEAST_SHARE}),
        g AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM found GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
            coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN g USING (r)""",
    "op2_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
            CAST(sum({len(START) + len(END) + 2} + {_escaped("role")} + {_count("role", chr(10))} + {_escaped("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op5_benchmark_decontamination": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, len(w) AS m, w AS win FROM i WHERE len(w) BETWEEN 1 AND 9
            UNION SELECT DISTINCT item_id, 10, w[s:s + 9] FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS s FROM i WHERE len(w) >= 10)),
        lengths AS (SELECT DISTINCT m FROM windows),
        places AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS s, w FROM d, lengths WHERE len(w) >= m),
        hits AS MATERIALIZED (SELECT r, s, places.m, item_id FROM places JOIN windows ON places.m = windows.m AND w[s:s + places.m - 1] = win),
        n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT r, s, m FROM hits)) GROUP BY r),
        k AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)""",
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)""",
    "op11_lexical_search": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        i AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
        c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
        p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
        t AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS wt FROM p, c GROUP BY term, n_docs),
        m AS (SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
        s AS (SELECT item_id, r, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN t USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r),
        k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s JOIN m USING (r) WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {TOP}""",
}


#: CRC-32 of an ASCII string s, bit by bit.
_CRC = """xor(list_reduce(range(0, 8 * len(s)), lambda a, i: xor((CASE WHEN i % 8 = 0 THEN xor(a, ascii(s[i // 8 + 1])) ELSE a END) >> 1,
    ((CASE WHEN i % 8 = 0 THEN xor(a, ascii(s[i // 8 + 1])) ELSE a END) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT)"""

_SQL["op12_prefix_trie"] = f"""
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
        sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM conversations WHERE conv_id IS NOT NULL),
    l AS (SELECT c, list(x ORDER BY p) AS xs, list(n ORDER BY p) AS ns FROM t GROUP BY c),
    k AS (SELECT c, c - c % 5 AS b, {_CRC} % 9 AS h FROM (SELECT c, CAST(c AS VARCHAR) AS s FROM l)),
    r AS (SELECT k.c, list_concat(coalesce(lb.xs[:h], []), l.xs[h + 1:]) AS xs, list_concat(coalesce(lb.ns[:h], []), l.ns[h + 1:]) AS ns
        FROM k JOIN l ON l.c = k.c LEFT JOIN l AS lb ON lb.c = k.b),
    m AS MATERIALIZED (SELECT c, d, len(xs) AS own, CASE WHEN d = 0 THEN '' ELSE sha256(array_to_string(xs[:d], ',')) END AS key,
        CASE WHEN d > 1 THEN sha256(array_to_string(xs[:d - 1], ',')) WHEN d = 1 THEN '' END AS up, coalesce(ns[d], 0) AS n
        FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM r)),
    g AS MATERIALIZED (SELECT key, d, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS save,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (own = d), '')) AS ends_sha256 FROM m GROUP BY key, d),
    f AS (SELECT up AS key, count(*) AS n_children FROM g WHERE d > 0 GROUP BY up),
    below AS (SELECT m.key, CAST(sum(g.save) AS BIGINT) AS saved_tokens, CAST(count(*) FILTER (f.key IS NULL) AS BIGINT) AS n_leaves
        FROM g LEFT JOIN f ON f.key = g.key JOIN m ON m.c = g.conv_id AND m.d <= g.d GROUP BY m.key)
    SELECT g.conv_id, g.d AS depth, a.conv_id AS parent_conv_id, g.n_convs, coalesce(f.n_children, 0) AS n_children, n_leaves, saved_tokens, g.ends_sha256
    FROM g JOIN below USING (key) LEFT JOIN f USING (key) LEFT JOIN g AS a ON a.key = g.up"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_license_scan, op2_chat_format, op3_quality_classifier, op4_token_packing, op5_benchmark_decontamination, op6_sentencepiece,
        op7_token_counts, op8_pii, op9_exact_dedup, op10_simhash_dedup, op11_lexical_search, op12_prefix_trie,
        op13_lm_scores)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
