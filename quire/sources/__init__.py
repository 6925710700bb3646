"""Sources and sinks: Parquet tables, CSV/JSON files, model and log stores."""
