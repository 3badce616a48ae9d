"""Plan helpers: cutting lineage in the shared folder and size-checked broadcasts."""
