"""scopeframe: identifier analysis and renaming over corpora of JavaScript sources, as PySpark DataFrames."""
