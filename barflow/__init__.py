"""barflow: multi-symbol market-series analytics on Spark DataFrames.

Every operator is a plain ``DataFrame -> DataFrame`` function. Series work is
keyed by ``symbol`` and ordered by ``date`` (or a bar timestamp); long series
are split into fixed-size row blocks with a halo so a single hot symbol never
lands in one task (see :mod:`barflow.operators.layout`).
"""

__version__ = "0.1.0"
