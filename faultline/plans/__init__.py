"""Composed analyses over the test-data panel: Spark plans and their SQL oracles."""
