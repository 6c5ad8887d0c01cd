"""Strandline: geospatial change analytics and corpus preparation as PySpark DataFrame operators."""
