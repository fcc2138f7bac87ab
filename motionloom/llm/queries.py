"""The thin opN queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, near_dedup, pii, quality, secrets, span_dedup, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Verdict, host, path of the URL rules.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies; never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, digested."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document; the model never sees a held-out label."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 80 percent or more of a benchmark item's 5-word shingles."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_found").cast("long").alias("n_found"))


def op4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand at an earlier place."""
    return span_dedup.without_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the verdict of the divergence rules for every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents over 2-word shingles at a similarity of 0.8."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in documents with the forest's verdict; a digest stands for the token."""
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.findings(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "start", "length", F.sha2("token", 256).alias("token_sha256"), "score", "is_secret")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key="motionloom")


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, deleted lines and the digest of what stays, for every document."""
    clean = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page's url."""
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_spans": op4_spans,
    "op5_quality": op5_quality,
    "op6_setsketch": op6_setsketch,
    "op7_secrets": op7_secrets,
    "op8_pii": op8_pii,
    "op9_line_runs": op9_line_runs,
    "op10_urls": op10_urls,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": r"""
        WITH item AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
             doc AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
             i AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM item)),
             d AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM doc)),
             n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
             f AS (SELECT doc_id, item_id, count(*) AS n_found FROM i JOIN d USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_item, n_found FROM f JOIN n USING (item_id) WHERE 100 * n_found >= 80 * n_item
    """,
    "op9_line_runs": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
             s AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
             w AS (SELECT doc_id, k, i, line, lead(line) OVER o AS next, lead(i) OVER o AS j FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
             r AS (SELECT *, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, k) AS copy FROM w WHERE next IS NOT NULL),
             g AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN r ON l.doc_id = r.doc_id AND l.i BETWEEN r.i AND r.j WHERE r.copy > 1)
        SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_deleted,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS text_sha256
        FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
    """,
}
