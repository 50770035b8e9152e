"""Scans of files, tables, page output and logs, and writers."""
