"""Two streaming jobs: latest edits and review progress."""
