"""DataFrame operators: datasets, statistics, sentiment, learning, graphs, power laws."""
