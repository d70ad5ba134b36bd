"""The library's queries, each beside its SQL; importing a module registers its queries."""
