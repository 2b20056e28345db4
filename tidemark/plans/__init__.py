"""Complete queries: the message monitor and the catalogue of named queries."""
