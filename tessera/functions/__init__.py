"""Column functions: chunking, extraction from code and rules over text."""
