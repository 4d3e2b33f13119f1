"""Column functions: text views, severity, tokens, numbers, decoding, cursors."""
