"""foliant: a document-library search and text-preparation engine on PySpark."""
