"""filedeck: corporate-filing analytics on PySpark."""
