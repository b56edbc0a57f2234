"""A PySpark engine for longitudinal sequence profiling."""
