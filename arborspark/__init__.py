"""arborspark: file and document hierarchies as DataFrames."""
