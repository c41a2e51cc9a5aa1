"""The index, the query strategies over it, and the registered queries."""
