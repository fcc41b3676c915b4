"""Row-wise operators on streaming tables."""
