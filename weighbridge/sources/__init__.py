from . import schemas
from .scratch import new_path, release, scratch, settle, settle_bucketed, shared_folder
from .tables import first_rows, read_csv, read_csv_with_problems, read_parquet, schema_profile, write_result

__all__ = ["schemas", "new_path", "release", "scratch", "settle", "settle_bucketed", "shared_folder", "first_rows", "read_csv", "read_csv_with_problems", "read_parquet",
           "schema_profile", "write_result"]
