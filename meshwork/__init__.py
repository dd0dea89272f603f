"""meshwork: network analytics and corpus preparation as PySpark DataFrame plans."""
