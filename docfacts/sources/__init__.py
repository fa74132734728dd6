"""Readers and writers for document folders, record files, tables and run logs."""
