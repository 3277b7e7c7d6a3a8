"""Record processors and streaming ingest."""
