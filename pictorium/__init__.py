"""Pictorium: a Spark-first engine for image-corpus data processing and retrieval.

Everything is expressed on DataFrames.  ``pictorium.operators`` holds the
relational and vector operators, ``pictorium.functions`` column expressions,
``pictorium.sources`` readers and writers, ``pictorium.plans`` the registered
queries with their SQL oracles and ``pictorium.streaming`` the micro-batch
intake.
"""
