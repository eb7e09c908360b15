"""A PySpark engine for georeferenced, timestamped sensor captures."""
