"""Readers and writers: dumps in, tables and text out."""
