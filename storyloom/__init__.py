"""storyloom: news and story analytics as Spark DataFrame jobs."""
