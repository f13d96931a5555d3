"""Gaussian linear mixed models on Spark."""
