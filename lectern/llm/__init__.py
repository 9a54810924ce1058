"""Operators for preparing training corpora: filtering, deduplication, scoring, mixing and packing."""
