"""DataFrame operators over versioned records."""
