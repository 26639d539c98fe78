"""yore: personal-history analytics as Spark DataFrame plans."""
