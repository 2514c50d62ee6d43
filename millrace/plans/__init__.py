"""Table adapters and the registry of named queries."""
