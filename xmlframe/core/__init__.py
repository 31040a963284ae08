"""Plain Python, without Spark: what runs inside Arrow functions on the executors, and what plans are made of."""
