"""Web-page discovery and content analysis as PySpark DataFrame and streaming jobs."""
