"""A PySpark engine for append-only fact logs, the graphs they imply, and ranked recall over them."""
