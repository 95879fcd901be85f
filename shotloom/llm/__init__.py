"""Operators for building training corpora at scale. Nothing outside imports this subpackage."""
