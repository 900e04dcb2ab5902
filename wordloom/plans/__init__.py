"""Named, runnable queries over the test tables."""
