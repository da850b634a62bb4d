"""Segment analytics of burst-sampled series, and operators around it, as Spark DataFrame transformations."""
