"""Ownership attribution for DNS inventories, as Spark DataFrame operators."""
