"""textloom: text search and corpus analytics as DataFrame plans."""
