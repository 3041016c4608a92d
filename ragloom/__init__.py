"""ragloom: retrieval, knowledge-graph and training-data analytics on PySpark DataFrames."""
