"""strata: tenant-partitioned, versioned objects on Spark DataFrames."""
