"""Helpers that shape physical plans: sessions, lineage cuts, skew handling."""
