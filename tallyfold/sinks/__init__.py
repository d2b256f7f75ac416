"""Writers: CSV snapshots, ordered text, table replacement."""
