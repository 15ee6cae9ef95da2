"""Schemas at the boundaries; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field and column names of the landed pages, the posting list and the export.
API_PAGE = """
page int,
results array<struct<
  title: string, description: string, redirect_url: string,
  company: string, location: string, category: string,
  contract_type: string, contract_time: string, salary_min: double, salary_max: double>>,
corrupt string
"""

POSTING_CSV = (
    "job_link string, job_title string, company string, job_location string, first_seen string, "
    "job_level string, job_type string, job_summary string, job_skills string"
)

EXPORT_COLUMNS = (
    "job_title", "company", "job_location", "work_mode", "industry", "employment_type_norm",
    "job_level_norm", "job_skills", "final_score", "nlp_score", "skill_score", "role_score",
    "salary_min", "salary_max", "job_link",
)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def with_missing_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Add absent optional columns as typed nulls."""
    absent = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df
