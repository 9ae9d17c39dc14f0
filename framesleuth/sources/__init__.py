"""Readers for evidence text and JSON, and sinks for reports."""
