"""Column-level helpers: every function takes and returns ``Column``."""
