"""DataFrame operators: reconciliation, profiling, matching, generation, rollups, gates, pages."""
