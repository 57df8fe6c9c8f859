"""Sources and sinks: corpora (Parquet / CSV / JSON), prompt catalogues,
recipe configs, stand-in corpora derived from the test tables, writers."""
