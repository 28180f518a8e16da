"""See the package docstring of ``glyphgrove``."""
