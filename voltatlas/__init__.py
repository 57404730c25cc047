"""Facility energy analytics as plain DataFrame-to-DataFrame Spark operators."""
