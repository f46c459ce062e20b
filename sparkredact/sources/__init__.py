"""Files in, reports out, settings."""
