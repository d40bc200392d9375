"""askloom: text retrieval and question-answering analytics as Spark plans."""

__version__ = "0.1.0"
