"""Set-based checks for retiring legacy data fields, as Spark DataFrame plans."""
