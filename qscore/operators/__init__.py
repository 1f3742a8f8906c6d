"""Set operations on snapshots, findings, scores, changes and reviews."""
