"""Tables with declared keys, their profiles, and graph snapshots."""
