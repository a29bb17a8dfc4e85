"""The models as a graph, the metric layer, and the registered queries with their oracles."""
