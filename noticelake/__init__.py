"""noticelake: notice analytics and document processing on Spark DataFrames."""
