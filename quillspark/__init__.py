"""A PySpark-native engine for topic knowledge bases: sources, graph, retrieval, chat, registry and courses."""
