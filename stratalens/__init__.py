"""Code-repository analytics as Spark DataFrame operators."""
