"""lumen: finds concealed content in documents at scale, on PySpark DataFrames."""
