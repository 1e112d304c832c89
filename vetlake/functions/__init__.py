"""Column functions: keys and hashes, robust statistics, prefix sums."""
