"""sparloom: contract and evaluation analytics as Spark dataflow."""
