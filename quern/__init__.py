"""quern: rules, matching, ranking and corpus preparation as Spark plans."""
