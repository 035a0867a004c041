"""Knowledge retrieval and governance operators expressed as PySpark DataFrame plans."""
