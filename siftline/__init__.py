"""Security and network log analytics as Spark DataFrame transformations."""
