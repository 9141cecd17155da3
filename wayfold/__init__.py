"""Navigation-mesh analytics on Spark: meshes, paths and world geometry as DataFrames."""
