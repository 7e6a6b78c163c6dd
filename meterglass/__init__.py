"""meterglass: usage analytics for token-metered tools, as Spark plans."""

__version__ = "0.1.0"
