"""Han-script conversion and detection on Spark."""
