"""Model calls, provider batches and streams."""
