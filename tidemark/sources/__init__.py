"""Sources: code files and extraction JSON."""
