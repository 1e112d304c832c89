"""vetlake: a Spark-first engine for auditing collections, scoring them robustly and evaluating detectors."""
