"""Tamarack: retrieval and event analytics expressed as Spark DataFrame plans."""
