"""Text clean-up, key building and label formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\r\n"


def trim_blanks(x: Column) -> Column:
    """Strip spaces, tabs and line ends from both sides (plain trim strips spaces only)."""
    return F.trim(x, F.lit(_BLANKS))


def country_code(x: Column) -> Column:
    return F.upper(trim_blanks(x.cast("string")))


def lower_label(x: Column) -> Column:
    return F.lower(trim_blanks(x))


def safe_int_key(x: Column) -> Column:
    """``0012`` -> ``12``; text that is no 32-bit integer -> NULL."""
    return x.cast("string").try_cast("int").cast("string")


def composite_key(*parts: Column, sep: str = "_") -> Column:
    """Join the parts; a NULL part is written as the text ``NA`` and keeps its place."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def fill_text(x: Column, fallback: Column) -> Column:
    """``fallback`` where x is NULL or the text ``NA``."""
    return F.coalesce(F.nullif(x, F.lit("NA")), fallback)


def truncate_label(x: Column, width: int = 22) -> Column:
    """Shorten to ``width`` characters, the closing ``...`` included."""
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 3), F.lit("..."))).otherwise(x)


def thousands(n: Column, mark: str = " ") -> Column:
    """1234567 -> ``1 234 567``."""
    return F.translate(F.format_number(n.cast("bigint"), 0), ",", mark)


def fixed_decimals(x: Column, digits: int = 3) -> Column:
    """Text with exactly ``digits`` decimals, halves rounded to even."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def snake_names(names: list[str]) -> list[str]:
    """Lower snake-case column names; repeats get ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        s = raw.replace("%", "_percent_").replace("#", "_number_").replace("'", "")
        s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
        s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
        s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower() or "x"
        s = f"x{s}" if s[0].isdigit() else s
        base, k = s, seen.get(s, 0) + 1
        seen[base] = k
        while k > 1 and f"{base}_{k}" in seen:
            k += 1
        name = base if k == 1 else f"{base}_{k}"
        seen.setdefault(name, 1)
        out.append(name)
    return out
