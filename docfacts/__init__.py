"""docfacts: the data work around document extraction, written as Spark jobs."""

__version__ = "0.1.0"
