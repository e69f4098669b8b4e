"""dayloom: daily-panel analytics written as Spark DataFrame transformations."""
