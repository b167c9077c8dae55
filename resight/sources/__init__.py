"""Reading tables under a fixed schema, and writing logs and snapshots."""
