"""Reading and writing tables, records, manifests and metrics."""
