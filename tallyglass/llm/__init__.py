"""Operators of a training-data pipeline: near-duplicate search, decontamination, filtering, mixing, packing.

Self-contained: nothing outside this folder imports it.
"""
