"""Place-review analytics as Spark jobs over tables and streams."""
