"""Ingest: Markdown files to a complete, calibrated index with its counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.embedder import Embedder
from gleanery.functions.vectors import word_counter
from gleanery.functions.words import model_text
from gleanery.operators import calibration
from gleanery.operators.sections import sections
from gleanery.params import DEFAULT_RANK, SENTINEL_THRESHOLD, RankParams
from gleanery.plans.index import PARTS, Index, build_index, with_parts, write_meta
from gleanery.plans.retrieve import embedded


def run_ingest(
    files: DataFrame,
    repo: str,
    commit: str,
    skipped: DataFrame | None = None,
    offtopic: Sequence[str] = (),
    params: RankParams = DEFAULT_RANK,
    root: str | None = None,
    embedder: Embedder | None = None,
    parts: Sequence[str] = PARTS,
) -> Index:
    """Split, index and calibrate. The sections are written once, as the passages of the index and what is dropped of
    them; counters are aggregates of them.

    With fewer `parts` the index is neither complete nor calibrated: `with_parts` and `calibrate` do the rest.
    """
    index = build_index(sections(files), repo, commit, params, None, skipped, root, embedder, ())
    text = model_text(F.col("text"), F.col("heading_path"))
    most = params.embedding.max_tokens
    # a text of n words has 2 n - 1 bytes at least: few are long enough for their words to be counted
    long = F.when(F.octet_length(text) >= 2 * (most - 1) - 1, text)
    counted = index.sections().agg(
        F.count_if(~F.col("kept") & (F.size("heading_path") > 0)).alias("empty"),
        F.count_if(F.col("kept") & (word_counter(index.spark)(long) + 2 > most)).alias("truncated"),
    ).first()
    index = replace(index, meta=replace(
        index.meta, files_read=files.count(), skipped=skipped.count() if skipped is not None else 0,
        empty_dropped=counted["empty"], truncated=counted["truncated"],
    ))
    index = with_parts(index, *parts)
    return calibrate(index, offtopic) if index.parts == frozenset(PARTS) else index


def calibrate(index: Index, offtopic: Sequence[str] = ()) -> Index:
    """Measure both null similarities and store the larger as the reference threshold."""
    vectors = index.table("vectors")
    salads = calibration.null_questions(index.table("passages"))
    tau = SENTINEL_THRESHOLD
    if salads is not None:
        tau = calibration.quantile_of_best(vectors, embedded(index, salads)).first()["tau"]
    off = None
    if offtopic and index.meta.passages:
        rows = index.spark.createDataFrame(list(enumerate(offtopic)), "qid bigint, question string")
        off = calibration.quantile_of_best(vectors, embedded(index, rows)).first()["tau"]
    return write_meta(
        index, tau_salad=tau, tau_offtopic=off, threshold=calibration.threshold(tau, off)
    )


def ingest_report(index: Index) -> DataFrame:
    """One row of counters."""
    return index.spark.read.parquet(f"{index.root}/meta").select(
        F.col("files_read").alias("files"), "passages", "skipped", "empty_dropped", "truncated"
    )
