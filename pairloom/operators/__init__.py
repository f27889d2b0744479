"""Operators over DataFrames: pairing, structured diffs, text measures, summaries, sinks."""
