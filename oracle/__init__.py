"""DuckDB texts that state the expected result of each registered query."""
