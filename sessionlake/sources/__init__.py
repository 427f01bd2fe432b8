"""Sources: files and landed tables of agents."""
