"""The repeated poll as a stream of landed snapshots."""
