"""The corpus problems for language models as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import clean_key
from ..plans.session import table
from .components import connected_groups
from .credentials import find_credentials, redact_credentials
from .handwritten import label_files
from .mixing import mix_sources, mixture_shares
from .sentences import sentence_units
from .syntax import failed, parse_files, parse_rates
from .tokens import decode_corpus, encode_corpus, token_counts

#: Tokenizer whose tokens size the mixture.
MIX_TOKENIZER = "byte_bpe_50k"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct (file, text) once; repeated rows are the same text."""
    return table(spark, sf_dir, "source_texts").select(clean_key("file_id").alias("file_id"), "project", "path", "text").where("file_id is not null")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_files(_texts(spark, sf_dir), table(spark, sf_dir, "library_files")).where("label is not null").select("file_id").distinct()


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with text: its label (hand_written where it has none) beside language and size of its latest file record."""
    labels = label_files(_texts(spark, sf_dir), table(spark, sf_dir, "library_files"))
    rec = table(spark, sf_dir, "file_records").select(clean_key("id").alias("file_id"), "language", "size", "recorded_at").groupBy("file_id").agg(
        F.max_by(F.struct("language", "size"), "recorded_at").alias("r"))
    return labels.join(rec, "file_id", "left").select("file_id", "path", F.col("r.language").alias("language"), F.col("r.size").alias("size"), "family", F.coalesce("label", F.lit("hand_written")).alias("label"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed(parse_files(_texts(spark, sf_dir))).select("file_id").distinct()


def p4_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with text against every grammar: those that take it, in the order of the ranking."""
    return parse_files(_texts(spark, sf_dir)).where("status <> 'empty'").select("file_id", "language", "ranked", "accepted", "status")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rates(parse_files(_texts(spark, sf_dir)))


def _secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda df, t, i, x: df.select(F.lit(t).alias("record_table"), clean_key(i).alias("record_id"), F.col(x).alias("text")).where("record_id is not null")
    return named(table(spark, sf_dir, "source_texts"), "source_texts", "file_id", "text").unionByName(named(table(spark, sf_dir, "evidence_items"), "evidence_items", "id", "snippet"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_credentials(_secret_texts(spark, sf_dir)).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_credentials(_secret_texts(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "relationships").select(clean_key("source_id").alias("source_id"), clean_key("target_id").alias("target_id")).where("target_id is not null")
    # A target without a source is linked with nothing but itself.
    g = connected_groups(rel.withColumn("source_id", F.coalesce("source_id", "target_id")), "source_id", "target_id")
    return g.select(F.col("node").alias("node_id"), F.col("group").alias("group_id"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids differ from the text; there are none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode_corpus(encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id", "left").where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))).select("doc_id")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", tokenizer=MIX_TOKENIZER)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.session import Workspace

    sized = Workspace(spark, "mix").write(_sized(spark, sf_dir), "sized")
    return mix_sources(sized, table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents").where("kind = 'prose'")).distinct()


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels, "p4_found": p4_found, "p4_grammars": p4_grammars, "p4_rates": p4_rates, "p5_found": p5_found, "p5_redacted": p5_redacted, "p7_found": p7_found, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found}

SQL = {
    "p7_found": r"""
WITH RECURSIVE e AS (
  SELECT DISTINCT coalesce(nullif(regexp_replace(source_id, '^\s+|\s+$', '', 'g'), ''), regexp_replace(target_id, '^\s+|\s+$', '', 'g')) AS a, regexp_replace(target_id, '^\s+|\s+$', '', 'g') AS b FROM relationships
  WHERE regexp_replace(target_id, '^\s+|\s+$', '', 'g') <> ''),
two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(node, grp) USING KEY (node) AS (
  SELECT a, a FROM two
  UNION
  SELECT two.a, min(cc.grp) FROM cc JOIN two ON cc.node = two.b JOIN recurring.cc AS r ON r.node = two.a WHERE cc.grp < r.grp GROUP BY two.a)
SELECT node AS node_id, grp AS group_id FROM cc""",
}
