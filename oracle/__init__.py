"""DuckDB SQL for every report, written apart from the library to check it."""
