"""Point-of-sale analytics as Spark DataFrame jobs."""

from tillstone.vocab import Branch, Vocabulary

__all__ = ["Branch", "Vocabulary"]
