"""clipspark: find, score, rank, audit and evaluate moments in recordings, on Spark."""

__version__ = "0.1.0"
