"""Column functions shared by operators, plans and serving queries."""
