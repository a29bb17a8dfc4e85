"""Where rows come from: files, streams, lookups, and the adapter of the test tables."""
