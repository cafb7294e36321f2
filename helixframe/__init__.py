"""helixframe: sequence, feature and ranking analytics as Spark DataFrames."""
