"""Training-data operators over `documents`, `pages` and `embeddings`; nothing else in the library imports this package."""
