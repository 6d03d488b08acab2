"""Structured Streaming: live telemetry and incremental ingestion."""
