"""Scalar functions: key and record codecs, text previews, sketches."""
