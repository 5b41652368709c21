"""Entity resolution, golden records and their analytics as lazy Spark plans."""
