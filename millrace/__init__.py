"""millrace: web pages and documents into clean, queryable, retrieval-ready tables, on Spark."""
