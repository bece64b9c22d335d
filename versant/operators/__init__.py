"""Operators on ordered, timed rows: runs, intervals, boundaries, frames, solvers."""
