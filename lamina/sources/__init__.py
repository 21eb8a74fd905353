"""Where tables lie: file systems, catalog, part store."""
