"""Readings of networks as Spark DataFrame operators."""
