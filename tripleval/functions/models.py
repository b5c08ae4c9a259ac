"""Model-id rules and small scalar rules used by run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size markers tested as substrings of the lowered model id,
# first category with a hit wins (so "13b" is medium because it contains "3b").
SIZE_MARKERS = [
    ("small", ["0.5b", "500m", "1b", "1.1b", "1.5b"]),
    ("medium", ["2b", "3b", "4b", "7b", "8b"]),
    ("large", ["9b", "13b", "70b"]),
]
# Documented parameter-count bands, billions: <2 small, 2-8 medium, >8 large.
SIZE_BANDS = (2.0, 8.0)
# parameter count followed by b/m and then a non-letter or the end
SIZE_PATTERN = r"(\d+(?:\.\d+)?)([bm])(?:[^a-z]|$)"
# Power-law exponent bands and fine-tune quality thresholds.
ALPHA_BANDS = (2.0, 6.0)
QUALITY_THRESHOLDS = (-1.0, 0.0)


def model_short_name(model_id: Column) -> Column:
    return F.element_at(F.split(model_id, "/"), -1)


def sql_model_short_name(e: str) -> str:
    return f"split_part({e}, '/', -1)"


def size_category(model_id: Column) -> Column:
    low = F.lower(model_id)
    out = None
    for cat, marks in SIZE_MARKERS:
        cond = None
        for m in marks:
            c = F.contains(low, F.lit(m))
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out.otherwise(F.lit("unknown"))


def sql_size_category(e: str) -> str:
    parts = []
    for cat, marks in SIZE_MARKERS:
        cond = " OR ".join(f"contains(lower({e}), '{m}')" for m in marks)
        parts.append(f"WHEN {cond} THEN '{cat}'")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


def size_billions(model_id: Column) -> Column:
    """Parameter count in billions read from the id (``1.5B``, ``500M``), else null."""
    low = F.lower(model_id)
    num = F.regexp_extract(low, SIZE_PATTERN, 1)
    unit = F.regexp_extract(low, SIZE_PATTERN, 2)
    val = F.when(num == "", None).otherwise(num.cast("double"))
    return F.when(unit == "m", val / 1000.0).otherwise(val)


def sql_size_billions(e: str) -> str:
    num = f"regexp_extract(lower({e}), '{SIZE_PATTERN}', 1)"
    unit = f"regexp_extract(lower({e}), '{SIZE_PATTERN}', 2)"
    val = f"(CASE WHEN {num} = '' THEN NULL ELSE CAST({num} AS DOUBLE) END)"
    return f"(CASE WHEN {unit} = 'm' THEN {val} / 1000.0 ELSE {val} END)"


def sql_size_category_numeric(e: str) -> str:
    lo, hi = SIZE_BANDS
    b = sql_size_billions(e)
    return (f"CASE WHEN {b} IS NULL THEN 'unknown' WHEN {b} < {lo} THEN 'small' "
            f"WHEN {b} <= {hi} THEN 'medium' ELSE 'large' END")


def size_category_numeric(model_id: Column) -> Column:
    b = size_billions(model_id)
    lo, hi = SIZE_BANDS
    return (F.when(b.isNull(), "unknown").when(b < lo, "small")
            .when(b <= hi, "medium").otherwise("large"))


def alpha_band(alpha: Column) -> Column:
    lo, hi = ALPHA_BANDS
    return (F.when(alpha.isNull(), None).when(alpha < lo, "over-trained")
            .when(alpha <= hi, "well-trained").otherwise("under-trained"))


def sql_alpha_band(e: str) -> str:
    lo, hi = ALPHA_BANDS
    return (f"CASE WHEN {e} IS NULL THEN NULL WHEN {e} < {lo} THEN 'over-trained' "
            f"WHEN {e} <= {hi} THEN 'well-trained' ELSE 'under-trained' END")


def finetune_quality_band(delta: Column) -> Column:
    a, b = QUALITY_THRESHOLDS
    return (F.when(delta.isNull(), None).when(delta < a, "excellent")
            .when(delta < b, "good").otherwise("needs adjustment"))


def sql_finetune_quality_band(e: str) -> str:
    a, b = QUALITY_THRESHOLDS
    return (f"CASE WHEN {e} IS NULL THEN NULL WHEN {e} < {a} THEN 'excellent' "
            f"WHEN {e} < {b} THEN 'good' ELSE 'needs adjustment' END")


def run_duration(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, double precision (microseconds kept)."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def sql_run_duration(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 1000000.0)"


def error_preview(error: Column, n: int = 100) -> Column:
    return F.when(error.isNull(), None).otherwise(F.concat(F.substring(error, 1, n), F.lit("...")))


def sql_error_preview(e: str, n: int = 100) -> str:
    return f"CASE WHEN {e} IS NULL THEN NULL ELSE substr({e}, 1, {n}) || '...' END"


def export_file_name(form: Column, ext: Column) -> Column:
    """``ir_triplets_{form}.{ext}`` with every unsafe character replaced by ``_``."""
    safe = F.regexp_replace(F.coalesce(form, F.lit("All")), r"[^A-Za-z0-9._-]", "_")
    return F.concat(F.lit("ir_triplets_"), safe, F.lit("."), ext)


def sql_export_file_name(form: str, ext: str) -> str:
    return (f"('ir_triplets_' || regexp_replace(coalesce({form}, 'All'), '[^A-Za-z0-9._-]', '_', 'g') "
            f"|| '.' || {ext})")
