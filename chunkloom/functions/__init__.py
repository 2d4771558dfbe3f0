"""Column functions: sizes, hashes, codecs."""
