"""Readers and writers: log lines, export records, the event table, reports and models."""
