"""Readers and writers for outputs, artifacts, runs and reports."""
