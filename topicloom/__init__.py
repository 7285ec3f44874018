"""A text analytics and topic discovery engine on Spark DataFrames."""

__version__ = "0.1.0"
