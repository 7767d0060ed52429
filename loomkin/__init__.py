"""loomkin: relational synthesis and analytics over Spark DataFrames."""
