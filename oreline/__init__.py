"""oreline: a Spark-first engine for grounded question-answering data.

Everything is a lazy DataFrame plan; Python runs only inside Arrow-batched
UDFs and only where Catalyst has no expression for the semantics.
"""
