"""Sources: saved bodies of stores, pages and communities as rows."""
