"""Sources: binding views over parquet tables, and the consultation lake."""
