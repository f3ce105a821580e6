"""Column functions: URLs, text, HTML, dates, vectors, money and validation."""
