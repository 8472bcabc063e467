"""graphloom: code-graph, search, quality and event analytics as Spark jobs."""
