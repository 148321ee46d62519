"""archspan: architecture-graph analytics as lazy PySpark DataFrame plans."""
