"""Training-data operators: ten corpus-scale steps built on DataFrames.

Nothing outside this folder imports it.
"""
