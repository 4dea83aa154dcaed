"""Row shapes of the data model and contracts on columns; violations come back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVAL = "id string, video_id string, start_sec double, end_sec double"
FRAME = "video_id string, frame_index int, timestamp double, path string, embedding array<float>"
MICRO_CLIP = f"{INTERVAL}, frame_indices array<int>, frame_timestamps array<double>, frame_paths array<string>, motion double, warnings array<string>"
STATE_REGION = f"{INTERVAL}, frame_indices array<int>, keyframe int, mean_change_score double"
SEGMENT = f"{INTERVAL}, speech_region_id string, text string, language string, warnings array<string>"
ACOUSTIC_REGION = f"{INTERVAL}, mean_rms double, peak_rms double, mean_spectral_change_score double, speech_overlap_ratio double, low_information_or_silence boolean"
CANDIDATE = f"{INTERVAL}, modality string, source_start double, source_end double, score double, roles array<string>, warnings array<string>"
RELATION = "source_id string, target_id string, relation_type string, gap double, confidence double, basis string"
ATTEMPT = "uid string, stage string, attempt int, status string, error_type string, pred string, elapsed_sec double, tokens long, images long"
TIMING = "stage_name string, parent_stage string, executed boolean, skipped boolean, skip_reason string, duration_sec double"
JOURNAL = "case_id string, stage string, attempt_number int, state string, at timestamp"
MANIFEST = "path string, bytes long, sha string"


def column_violations(df: DataFrame, name: str, allowed: list[str]) -> DataFrame:
    """name, rule (missing or extra), detail."""
    have = set(df.columns)
    rows = [(name, "missing", c) for c in allowed if c not in have] + [(name, "extra", c) for c in df.columns if c not in set(allowed)]
    return df.sparkSession.createDataFrame(rows, "name string, rule string, detail string")


def leaks(value: Column, fragments: list[str]) -> Column:
    """Whether any value of a struct, at any depth, contains one of the fragments in any case."""
    low = F.lower(F.to_json(value))
    hit = F.lit(False)
    for f in fragments:
        hit = hit | low.contains(f.lower())
    return F.coalesce(hit, F.lit(False))


def schema_key_leaks(df: DataFrame, forbidden: set[str]) -> list[str]:
    """Paths of forbidden field names in the schema, at any depth."""
    out: list[str] = []

    def walk(t, path: str) -> None:
        for f in getattr(t, "fields", []):
            p = f"{path}.{f.name}".lstrip(".")
            if f.name.lower() in forbidden:
                out.append(p)
            walk(f.dataType, p)
        for part in ("elementType", "valueType", "keyType"):
            if hasattr(t, part):
                walk(getattr(t, part), path)

    walk(df.schema, "")
    return out
