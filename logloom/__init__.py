"""Robot-log analytics as Spark DataFrame plans."""
