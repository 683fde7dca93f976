"""Relational metapath analytics and training-data preparation on Spark."""
