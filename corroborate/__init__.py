"""Evidence-corpus analytics as Spark DataFrame transformations."""
