"""Sightline: site and citation visibility analytics as Spark DataFrame operators."""
