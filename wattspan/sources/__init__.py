"""Readers and writers: raw meter lines, JSON messages, the readings table, synthetic data."""
