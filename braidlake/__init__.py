"""A versioned analytics engine on PySpark."""
