"""Plans over the driver's tables: derived views, the query catalogue, and the batch pipeline."""
