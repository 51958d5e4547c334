"""textforge: Spark-native text-corpus, summary-evaluation and inference-log analytics.

Every operator is a function from DataFrame (or Column) to DataFrame (or
Column) built on the DataFrame API so Catalyst can prune, push down and
codegen it. Python workers appear only where no native expression exists
(LCS-based ROUGE, pluggable model functions, streaming state).
"""

__version__ = "0.1.0"
