"""flowloom: geo-located interaction graphs on PySpark."""
