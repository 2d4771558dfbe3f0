"""Content-defined chunking, deduplication and delta analytics over byte data, on Spark."""
