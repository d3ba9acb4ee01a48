"""Where records come from: tables, text lines, JSON, the block language."""
