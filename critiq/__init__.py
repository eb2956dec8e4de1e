"""critiq: review-quality analytics on Spark.

Everything between model calls is DataFrame expressions, windows, joins and
MLlib.  A language model, when wanted, is a plain batch function from prompts
to completions supplied by the user (see ``critiq.operators.backend``).
"""

__version__ = "0.1.0"
