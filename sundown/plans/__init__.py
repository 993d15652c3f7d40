"""Bindings of the operators to the warehouse tables, with their SQL twins."""
