"""Compositions of operators: the load plan, the table catalog, sinks."""
