"""Release-risk analytics on Spark: generalise, measure privacy, measure utility."""
