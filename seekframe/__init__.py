"""Search and index maintenance over files and documents, as Spark DataFrames."""
