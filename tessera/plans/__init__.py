"""Registered queries over the driver tables: a Spark builder and the
equivalent DuckDB SQL for each key."""
