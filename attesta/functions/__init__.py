"""Column expressions. Nothing here scans, shuffles or collects."""
