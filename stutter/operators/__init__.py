"""DataFrame operators: exact and tolerant repeats, intervals, coverage."""
