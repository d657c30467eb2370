"""Table-driven parsers of bundled grammars."""
