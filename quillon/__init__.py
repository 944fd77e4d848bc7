"""A PySpark engine that audits manuscripts and reference lists as DataFrames."""
