"""Reading tables, dictionaries and document indexes; writing results."""
