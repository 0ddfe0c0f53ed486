"""kinfold: pedigree genomics on PySpark DataFrames."""
