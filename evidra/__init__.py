"""Evidence analytics on Spark: search, record linkage, screening and reporting as DataFrame plans."""
