"""wirelake: Spark DataFrame operators for technical-document and component-graph data."""

__version__ = "0.1.0"
