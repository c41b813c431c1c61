"""Task files, their validation, running, lineage and tooling."""
