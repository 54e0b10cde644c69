"""corpusloom: learning-based data programs and text analytics as Spark plans."""
