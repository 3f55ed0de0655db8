"""Tables of points: from data tables, lattices, text files."""
