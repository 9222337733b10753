from . import basics, stored, survey, tidy
from .registry import QUERIES, SQL, UNCHECKED

__all__ = ["QUERIES", "SQL", "UNCHECKED", "basics", "stored", "survey", "tidy"]
