"""Which column plays which part. Every plan takes its names from here."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    year: str = "year"
    country: str = "country"
    country_name: str = "country_name"
    region: str = "ilo_subregion"
    group: str = "world_bank_income_group"
    student: str = "student_id"
    school: str = "school_id"
    school_key: str = "school_uid"
    gender: str = "gender"
    sector: str = "public_private"
    funding: str = "fund_gov"
    ratio: str = "stratio"
    background: str = "escs"
    score: str = "avg_score"
    weight: str = "stu_wgt"
    spending: str = "percentage_education_on_gdp"
    gdp: str = "GDP_per_PPP_2022"
    parity: str = "gender_parity_index"
    school_level: str = "school_level"


DEFAULT = Roles()
