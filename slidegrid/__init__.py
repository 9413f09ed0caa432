"""Analytics over very large tables of segmented image objects, written as Spark jobs."""
