"""Sources: folders of Markdown documents, their schemas, and snapshots of parsed folders."""
