"""Canonical schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSCRIPTS = "replicate int, ordinal int, transcript_id string, sequence string, n_reads long"
READS = "replicate int, transcript_id string, read_id long, begin int, end int, idx array<int>"
WINDOWS = "transcript_id string, window_idx int, start int, end int"
PTBA = "replicate int, transcript_id string, window_idx int, n_clusters int, status string, gaps array<double>, null_gaps array<array<double>>"
CONSENSUS = "transcript_id string, window_idx int, n_clusters int, confidence double"
WEIGHTS = "replicate int, transcript_id string, window_idx int, w array<array<float>>"
REGIONS = "replicate int, transcript_id string, region_idx int, start int, end int, n_clusters int, win_begin int, win_end int, w array<array<float>>, coverage array<long>"
MERGED = f"{REGIONS}, members array<int>"
ASSIGNMENTS = "replicate int, transcript_id string, region_idx int, read_id long, cluster int"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
