"""News analytics on Spark DataFrames: feeds, themes, words, summaries, reports and timestamps."""

__version__ = "0.1.0"
