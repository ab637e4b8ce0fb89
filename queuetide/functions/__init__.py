"""Column functions: calendar, rounding, quantiles, text."""
