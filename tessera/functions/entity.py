"""Person keys out of semi-structured characteristics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key names (longer ones first, as the first alternative wins) and placeholders.
KEYS = ("patient id", "patientid", "patient_id", "subject id", "subjectid", "subject_id", "individual id", "individualid", "individual_id", "donor id", "donorid", "donor_id", "patient", "subject", "individual", "donor")
PLACEHOLDERS = ("na", "n/a", "none", "unknown", "-", "?", "not available")
# Fixed values end.
PATTERN = r"(?i)(?:^|[,;\n])\s*(?:" + "|".join(KEYS) + r")\s*[:=]\s*([^,;\n]+)"


def patient_id(text: Column) -> Column:
    """The value of the first key; null if there is none, it is empty or a placeholder (later keys aren't tried)."""
    value = F.lower(F.regexp_replace(F.regexp_extract(text, "(?U)" + PATTERN, 1), r"(?U)^\s+|\s+$", ""))
    return F.when((value != "") & ~value.isin(*PLACEHOLDERS), value)


def patient_key(series: Column, pid: Column, fallback: Column, row: Column) -> Column:
    """``series::id``, else a key of the sample's own, from its accession or its row."""
    own = F.concat(F.lit("__unresolved__::"), F.coalesce(F.nullif(fallback, F.lit("")), F.concat(F.lit("sample_"), row.cast("string"))))
    return F.coalesce(F.when((series != "") & pid.isNotNull(), F.concat(series, F.lit("::"), pid)), own)


def coverage(df: DataFrame, key: str, resolved: str) -> DataFrame:
    """One row: samples, those with a key, the share in percent, distinct resolved and fallback keys."""
    n, k = F.count(F.lit(1)), F.count_if(resolved)
    return df.agg(
        n.alias("n_samples"), k.alias("n_with_key"), F.round(F.coalesce(F.try_divide(k * 100.0, n), F.lit(0.0)), 4).alias("coverage_pct"),
        F.count_distinct(F.when(F.col(resolved), F.col(key))).alias("n_resolved"), F.count_distinct(F.when(~F.col(resolved), F.col(key))).alias("n_fallback"),
    )
