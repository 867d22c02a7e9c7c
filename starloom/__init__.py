"""Dimensional analytics on plain Apache Spark: pure DataFrame operators driven by entity specs."""
