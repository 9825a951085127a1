"""tessera: estimators, transformers, metrics and streaming learners expressed as Spark plans."""

__version__ = "0.1.0"
