"""DataFrame operators: joins, aggregates, windows, selections, rasters and keyed state."""
