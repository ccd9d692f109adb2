"""Writers: run-scoped tables, report extracts, run log and publication pointer."""
