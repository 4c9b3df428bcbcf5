"""steerclust: feedback-steered clustering of documents and vectors as Spark DataFrame jobs."""

__version__ = "0.1.0"
