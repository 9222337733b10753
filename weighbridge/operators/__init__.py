from . import columns, grouped, joins, models, pick, quality, quantiles, reshape, rows, sketches, split, trends

__all__ = ["columns", "grouped", "joins", "models", "pick", "quality", "quantiles", "reshape", "rows", "sketches", "split", "trends"]
