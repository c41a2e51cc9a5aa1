"""Reading collections and patterns; writing and reading index tables and reports."""
