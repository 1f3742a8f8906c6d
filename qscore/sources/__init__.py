"""What is read and written: snapshots, logs, policies, reports."""
