from statsmith.sources.io import preview, read_parquet, read_table, write_csv

__all__ = ["read_table", "read_parquet", "preview", "write_csv"]
