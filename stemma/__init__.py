"""Stemma: probabilistic queries over sequences and directed hypergraphs, as Spark plans."""
