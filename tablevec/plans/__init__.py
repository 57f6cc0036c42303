"""Registered queries: each module maps names to a Spark query and, where SQL can say it, its SQL."""
