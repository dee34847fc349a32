"""Column expressions: text clean-up, matching and scores."""
