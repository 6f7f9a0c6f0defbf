"""traceaudit: audits of language-model outputs and query traffic as PySpark jobs."""

__version__ = "0.1.0"
