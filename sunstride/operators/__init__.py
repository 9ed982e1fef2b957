"""DataFrame to DataFrame operators on panels (entity, timestamp, measures)."""
