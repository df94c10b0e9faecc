"""Spark operators for longitudinal event data: visits, token sequences, cohorts, batches, evaluation."""
