"""Training-data preparation operators (ten methods) on Spark DataFrames.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers
its queries only when it is importable.
"""
