"""Plan helpers: session settings, lineage cuts, size checks."""
