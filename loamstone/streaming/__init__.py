"""Structured Streaming operators. ts columns without a zone are cast, as watermarks need one."""
