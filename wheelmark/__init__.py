"""Landing analytics on Spark: scans, kinematic streams, touchdown estimators, fusion and validation."""
