"""Regime-aware cleaning of sampled signals, written as Spark jobs."""
