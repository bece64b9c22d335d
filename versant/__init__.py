"""Spark-first analytics for aligning timed, noisy transcript segments with reference units."""
