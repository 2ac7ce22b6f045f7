"""DuckDB SQL for the queries that SQL can express, by query name."""

from lodestone.llm import lexical, licenses, merkle

op4_scan_licenses = licenses.duckdb_sql()
op11_merkle_manifest = merkle.duckdb_sql()
op13_ranked_search = lexical.duckdb_sql()
