"""Reading files, archives and settings into DataFrames."""
