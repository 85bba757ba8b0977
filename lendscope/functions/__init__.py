"""Column-expression helpers. Everything here returns a ``Column`` and stays JVM-side."""
