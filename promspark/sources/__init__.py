"""File sources and sinks (CSV, CSV-in-ZIP, parquet, registries)."""
