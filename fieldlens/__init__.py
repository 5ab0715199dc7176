"""A PySpark engine for player-tracking analytics: sources, operators, plans and streaming."""
