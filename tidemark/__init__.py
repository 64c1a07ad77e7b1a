"""Point-in-time research analytics and training-data preparation on PySpark."""
