"""Galena: catalogue analytics and training-data operators on PySpark."""
