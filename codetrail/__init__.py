"""codetrail: mining source-code history with Spark DataFrames."""

__version__ = "0.1.0"
