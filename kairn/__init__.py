"""kairn: metric clustering and similarity analytics on Spark DataFrames."""
