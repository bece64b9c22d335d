"""Plans that put operators together: alignment, reports, queries."""
