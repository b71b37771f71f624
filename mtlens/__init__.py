"""mtlens: translation-quality analytics on Spark DataFrames.

Every operator is a plain function ``DataFrame -> DataFrame`` (usable with
``df.transform``); lexicons, thresholds, metric lists and column names are
arguments.
"""

__version__ = "0.1.0"
