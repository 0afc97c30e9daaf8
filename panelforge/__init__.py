"""panelforge: event records to entity-by-month panels, sorts, lattices and statistics on Spark."""
