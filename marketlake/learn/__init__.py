"""Price models on Spark ML: preparation, fitting, metrics, importance, scoring."""
