"""factloom: fact tables, lookups, trace corpora and corpus operators on PySpark."""

__version__ = "0.1.0"
