"""Knowledge-base jobs as Spark DataFrames."""
