"""Settings, whole selections, and the query catalog."""
