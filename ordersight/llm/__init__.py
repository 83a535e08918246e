"""Operators of a training-data pipeline (dedup, PII, decontamination, packing, ...)."""
