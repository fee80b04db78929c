"""forumlens: search, clean, profile, compare and classify public forum posts on Spark."""
