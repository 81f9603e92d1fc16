"""Named queries and whole studies."""
