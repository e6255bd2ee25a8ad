"""lexivec: document-centric analytics on PySpark."""
