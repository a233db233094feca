"""typeloom: schema-driven modelling and validation on Spark DataFrames."""

__version__ = "0.1.0"
