"""Market-panel, event, document and stream analytics as Spark jobs."""
