"""Set-at-a-time text, page, task and conversation operators on PySpark DataFrames."""
