"""Questions about a graph, the methods that answer them, and how answers are kept."""
