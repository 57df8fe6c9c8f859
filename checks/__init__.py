"""Independent DuckDB SQL oracles and a local Spark-vs-DuckDB comparer."""
