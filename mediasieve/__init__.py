"""Spark jobs over tables of media files and over the text of large corpora."""
