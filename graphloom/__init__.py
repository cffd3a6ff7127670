"""graphloom: property-graph, retrieval and corpus analytics written for Spark."""
