"""Operators of a training-data pipeline: quality, decontamination, language, privacy, scoring, dedup, archives, packing."""
