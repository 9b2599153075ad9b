"""Reading and writing: page tables, index files, embedding models."""
