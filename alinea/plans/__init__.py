"""Plan helpers: lineage cuts, skew-safe joins, and the registered queries."""
