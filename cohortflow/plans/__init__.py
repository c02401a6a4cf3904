"""The study as Spark plans: cohort, exposures, attributes, descriptives, models."""
