"""The queries of this package, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import spread, table
from .decontamination import contamination
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .language_id import language_id
from .line_dedup import line_dedup_digests
from .lm_scoring import lm_scores
from .ranked_search import ranked_search
from .sentencepiece_codec import encode_decode
from .simhash import simhash_classes
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .toxicity import toxicity


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the whole texts with begin and end, as digests, and what they decode to."""
    return encode_decode(spread(table(spark, sf_dir, "documents")), tokenizer("piece_bpe_32k.model"), keep_ids=False)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows of 13 of the benchmark, items that occur, and whether a twentieth is hit.  Builds by running its scans."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that a text is toxic, learned outside one fold in four.  Builds by fitting on its sample."""
    return toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left where windows of 35 that start elsewhere too are gone.  Builds by running its sketches."""
    return substring_dedup(spread(table(spark, sf_dir, "documents")), keep_text=False)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of each group of texts that are equal but for blanks."""
    return exact_dedup(spread(table(spark, sf_dir, "documents")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left where later windows of three lines are gone."""
    return line_dedup_digests(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden Markov scores beside those of single words, learned outside one fold in seven.  Builds by training."""
    return lm_scores(spread(table(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and bytes of the whole texts, and which are over 1,024.  Builds by counting frequent chunks."""
    return token_counts(spread(table(spark, sf_dir, "documents")), tokenizer("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest language of each text, learned outside one fold in four.  Builds by fitting on its sample."""
    return language_id(spread(table(spark, sf_dir, "documents")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and components at three bits.  Builds by rounds of components."""
    return simhash_classes(spread(table(spark, sf_dir, "documents")))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.98 within a label, and their components, of all vectors."""
    return embedding_dedup(spread(table(spark, sf_dir, "embeddings")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item, of all documents."""
    return ranked_search(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by language, over all documents."""
    return filter_audit(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece_codec, op2_decontamination, op3_toxicity, op4_substring_dedup, op5_exact_dedup, op6_line_dedup, op7_lm_scoring, op8_token_counts, op9_language_id, op10_simhash_near_dedup, op11_embedding_near_dedup, op12_ranked_search, op13_filter_audit)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
        ), lens AS (SELECT DISTINCT n FROM bw
        ), dw AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)
        ), hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
        ), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
        ), its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
        ), rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1
        ), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep
        ), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op6_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
        ), win AS (
            SELECT doc_id, i, md5(array_to_string(l[i : i + 2], chr(10))) AS g
            FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)
        ), late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
        ), gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM late
        ), lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d
        ), kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t, count(*) AS n
            FROM lines ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), s AS (SELECT count(*) AS n_docs, sum(len(w)) AS l FROM d WHERE len(w) > 0
        ), q AS (
            SELECT item_id, t, count(*) AS mult
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
            GROUP BY ALL
        ), tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL
        ), weight AS (
            SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY t
        ), score AS (
            SELECT item_id, doc_id, CAST(sum(mult * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * n * n_docs) // l AS BIGINT))))) AS BIGINT) AS score
            FROM tf JOIN q USING (t) JOIN weight USING (t), s GROUP BY item_id, doc_id
        ), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 20""",
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), m AS (
            SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
                   CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS mask
            FROM d
        ), c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
        ), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
        ), o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), k AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
        SELECT part, filter_order, step,
               CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
               CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
               CAST(sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
               CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
               CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
               CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
               CAST(sum(CASE WHEN mask & own > 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
        FROM c, k GROUP BY part, filter_order, step""",
}
