"""The registered query of each text operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, hosts, jaccard_join, language, quality, substring_dedup, suffix_dedup, toxicity
from .common import read


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(read(spark, sf_dir, "documents"), quality.grades_of(read(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(read(spark, sf_dir, "documents"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return hosts.judge(pages, hosts.outcomes_by_document(pages, read(spark, sf_dir, "labels")), hosts.RULES)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))
    # One row per row of the table again, in two steps so that no list is long.
    out = out.withColumn("some", F.explode(F.expr("sequence(0L, (n_rows - 1) div 4096)")))
    out = out.withColumn("one", F.explode(F.expr("sequence(1L, least(4096L, n_rows - 4096 * some))")))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_reputation": op5_url_reputation,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}

#: Words: runs of anything but space and tab to carriage return.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL over all 50-byte windows is too slow on whole tables: op4 is tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op7_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        cc(id, lbl) USING KEY (id) AS (
          SELECT doc_id, doc_id FROM documents
          UNION
          SELECT r.id, min(cc.lbl) FROM cc JOIN both_ e ON e.b = cc.id JOIN recurring.cc r ON r.id = e.a WHERE cc.lbl < r.lbl GROUP BY r.id
        )
        SELECT cc.id AS doc_id, coalesce(n.n, 0) AS n_shingles, cc.lbl AS component_id FROM cc LEFT JOIN n ON n.doc_id = cc.id
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op10_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        v AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM v),
        starts AS (SELECT doc_id, i FROM r WHERE k > 1),
        b AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
        marked AS (SELECT b.doc_id, b.i, b.x,
                     coalesce(b.i - max(s.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS UNBOUNDED PRECEDING) < 20, false) AS gone
                   FROM b LEFT JOIN starts s ON s.doc_id = b.doc_id AND s.i = b.i),
        done AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN done USING (doc_id)
    """,
}
