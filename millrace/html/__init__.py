"""Pages: a tolerant tree, its preparation, main content, Markdown and structured extraction."""
