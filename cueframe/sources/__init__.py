"""Tables, views over them, and media files as DataFrames."""
