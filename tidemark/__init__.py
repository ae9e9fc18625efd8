"""Longitudinal, per-subject event data on Spark: cohorts, histories, labels, features and evaluation."""
