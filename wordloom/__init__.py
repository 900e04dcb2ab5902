"""Analytics over noisy multilingual text corpora, written on Spark DataFrames.

sources, functions, operators, streaming and plans are independent of the training-data operators in the subpackage llm.
"""
