"""tabsmith: profile, check, clean, encode, split, train, compare and score tables on Spark."""

__version__ = "0.1.0"
