"""notewell: retrieval, link-graph, work-queue and corpus operators as PySpark jobs."""
