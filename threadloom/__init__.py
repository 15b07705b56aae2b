"""threadloom: a Spark-first analytics engine for agent-session logs.

Every operator takes and returns lazy DataFrames.  Names starting with an
underscore are private; everything else in a module is public API.
"""

__version__ = "0.1.0"
