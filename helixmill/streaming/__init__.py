"""Read files that keep arriving, classified as they come."""
