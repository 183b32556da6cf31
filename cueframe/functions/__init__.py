"""Column builders: text, timecodes and numbers, hashing and JSON."""
