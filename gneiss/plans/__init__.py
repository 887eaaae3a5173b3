"""Query plans: the catalogue over Parquet tables and the recovery of an image."""
