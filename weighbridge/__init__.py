"""Weighted survey analytics as Spark DataFrame plans.

``functions``  column expressions (text clean-up, recoding, weighted aggregates)
``operators``  DataFrame -> DataFrame building blocks
``sources``    declared schemas, readers, sinks and the shared scratch folder
``plans``      complete survey questions built from the operators
``catalogue``  the same questions asked of the TPC-H-like test tables
"""
