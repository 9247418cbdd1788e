"""Readers: bars and chains as views over base tables, files and nested records."""
