"""callgrid: telecom record analytics on Spark."""
