"""Operators that prepare training data: near-dedup, decontamination, sharding, scans, scoring, mixing and binary output."""
