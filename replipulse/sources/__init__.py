"""Readers of landed tables and writers of reports."""
