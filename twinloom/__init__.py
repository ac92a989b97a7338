"""Leakage-safe paired-text analytics expressed as Spark DataFrame plans."""
