"""Query catalogue: named plans over a directory of Parquet tables, each with its SQL."""
