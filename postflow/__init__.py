"""Post-stream analytics on Spark: ingest, enrich, keep state, index and query short public posts."""
