"""Readings of networks: every operator takes and returns DataFrames."""
