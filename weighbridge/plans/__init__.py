from . import audit, gaps, indicators, modelling, prepare, reports
from .roles import DEFAULT, Roles

__all__ = ["audit", "gaps", "indicators", "modelling", "prepare", "reports", "DEFAULT", "Roles"]
