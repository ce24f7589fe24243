"""Incremental processing (the reference's resumable tagging, A8/D9)."""
