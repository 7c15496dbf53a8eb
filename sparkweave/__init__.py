"""Community detection and graph analytics as PySpark DataFrame programs."""
