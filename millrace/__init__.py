"""Select-project-join analytics on Spark: typed sources, predicates, join plans and their front ends."""
