"""Relational operators: table engines, compaction, projection, granules."""
