"""Column expressions. Everything here returns a ``Column`` and stays inside Spark's own functions."""
