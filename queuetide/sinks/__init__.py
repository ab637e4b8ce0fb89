"""Writers and published snapshots."""
