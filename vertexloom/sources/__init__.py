"""Graph sources and sinks: sample data, relational tables, snapshot store, catalog."""
