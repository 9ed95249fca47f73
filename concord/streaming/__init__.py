"""Nothing yet: validation compares two datasets at rest, so no operator here takes a stream."""
