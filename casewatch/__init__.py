"""Safety-surveillance analytics over spontaneous-report tables, written as Spark DataFrame plans."""
