"""Engine for preparing, searching and evaluating document collections on Spark."""
