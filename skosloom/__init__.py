"""skosloom: concept-hierarchy analytics as lazy Spark DataFrames."""
