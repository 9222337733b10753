"""Declared schemas of the survey tables. Types are fixed here, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"INT": T.IntegerType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType()}


def _schema(text: str) -> T.StructType:
    """Built without a running session, unlike ``StructType.fromDDL``."""
    fields = [item.split() for item in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


STUDENT = _schema(
    "year INT, country STRING, school_id STRING, student_id STRING, gender STRING, "
    "escs DOUBLE, math DOUBLE, read DOUBLE, science DOUBLE, stu_wgt DOUBLE"
)
SCHOOL = _schema(
    "country STRING, year INT, school_id STRING, public_private STRING, fund_gov DOUBLE, "
    "stratio DOUBLE, enrol_boys DOUBLE, enrol_girls DOUBLE, staff_shortage DOUBLE, school_size DOUBLE"
)
REGION_INCOME = _schema(
    "country STRING, country_name STRING, ilo_region STRING, ilo_subregion STRING, "
    "ilo_subregion_detail STRING, world_bank_income_group STRING, ilo_member STRING"
)
GDP = _schema("country STRING, country_name STRING, GDP_per_PPP_2022 DOUBLE")
GENDER_INDEX = _schema("country STRING, year INT, school_level STRING, gender_parity_index DOUBLE")
EXPENDITURE = _schema("country STRING, year INT, percentage_education_on_gdp DOUBLE")
