"""lodestrata: Spark-native curation and evaluation of labelled source-code corpora.

Every operator takes and returns DataFrames (or Columns); plans are declared
and left to Catalyst, Python runs only over Arrow batches.
"""

__version__ = "0.1.0"
