"""Time-lagged regression analytics and series preparation on Spark."""
