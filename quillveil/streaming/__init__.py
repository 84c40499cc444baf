"""The same per-document operators on streams."""
