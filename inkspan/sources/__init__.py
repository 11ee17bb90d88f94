"""Sources and sinks: documents, datasets, pictures, objects."""
