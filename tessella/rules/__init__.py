"""Safety rules over the schema model."""
