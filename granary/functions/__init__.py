"""Column functions: everything here returns a ``Column``."""
