"""Registered queries, with the equivalent DuckDB SQL."""
