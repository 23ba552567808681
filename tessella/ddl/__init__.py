"""Reading SQL definition text: statements, facts, objects, checks, replay."""
