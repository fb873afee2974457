"""lakeprofile: data profiling and data-quality analytics as Spark plans."""
