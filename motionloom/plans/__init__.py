"""Queries: every operator applied to the supplied tables. Importing a module registers its queries."""
