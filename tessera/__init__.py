"""tessera: a PySpark-native engine for agent-memory, ledger and code-graph analytics."""
