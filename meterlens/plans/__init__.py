"""Whole analyses: the full run, and the queries over the benchmark tables with their oracles."""
