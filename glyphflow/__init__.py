"""Legacy-encoded text to Unicode at corpus scale, and operators for training data, on Spark."""
