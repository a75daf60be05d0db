"""Program-based question answering over text and tables, as Spark DataFrame work."""
