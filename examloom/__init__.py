"""examloom: exam-question training data, evaluation and credit tables as Spark DataFrames."""

__version__ = "0.1.0"
