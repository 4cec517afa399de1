"""Set-oriented listing analytics and text-corpus operators on PySpark."""
