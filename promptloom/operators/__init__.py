"""DataFrame -> DataFrame operators grouped by the reference's work areas."""
