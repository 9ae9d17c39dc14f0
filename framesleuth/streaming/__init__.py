"""Structured Streaming jobs over telemetry and heartbeats."""
