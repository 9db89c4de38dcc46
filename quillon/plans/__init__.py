"""Plans: text, operators that ran, their metrics."""
