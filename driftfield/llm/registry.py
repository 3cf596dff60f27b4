"""Queries and oracle SQL of the text operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftfield.llm import decontamination, line_dedup, media, mixing, quality, secrets, simhash, substring_dedup, suffix_dedup, warc
from driftfield.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def _documents(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc": lambda spark, sf_dir: warc.query(read(spark, sf_dir, "pages")),
    "op2_line_dedup": _documents(line_dedup.query),
    "op3_substring_dedup": _documents(substring_dedup.query),
    "op4_decontamination": lambda spark, sf_dir: decontamination.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    "op5_suffix_dedup": _documents(suffix_dedup.query),
    "op6_quality": lambda spark, sf_dir: quality.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
    "op7_secrets": _documents(secrets.query),
    "op8_media": _documents(media.query),
    "op9_simhash": _documents(simhash.query),
    "op10_mixing": _documents(mixing.query),
    # Those columns of two operators that SQL can express.
    "secrets_base": _documents(lambda docs: secrets.query(docs).select("doc_id", "n_assign", "n_access", "n_hex")),
    "media_payload": _documents(lambda docs: media.query(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")),
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "secrets_base": secrets.ORACLE,
    "media_payload": media.ORACLE,
}
