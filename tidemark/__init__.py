"""tidemark: intent, advertising and retrieval analytics as plain Spark DataFrame jobs.

Sub-packages
------------
functions   column builders (text, URL, hashing, statistics) and fixed word lists
sources     typed table scans, payload parsing, and the adapters over the given test tables
operators   DataFrame -> DataFrame operators
streaming   Structured Streaming twins of the event operators
plans       the registered queries and the SQL each one is checked against
"""

__version__ = "0.1.0"
