"""Query privatization on Spark: policy catalogue, possible-worlds and elastic-sensitivity compilers."""
