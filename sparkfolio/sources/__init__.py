"""Sources and sinks: pages, files, landing folders, snapshots, extracts."""
