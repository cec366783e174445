"""Tessera: model-evaluation analytics and corpus processing as Spark programs."""
