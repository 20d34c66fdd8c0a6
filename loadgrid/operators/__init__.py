"""DataFrame -> DataFrame operators on long load tables."""
