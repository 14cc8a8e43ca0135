"""Structured Streaming operators (sources, snapshots, stream mining)."""
