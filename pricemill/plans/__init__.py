"""Table plans (silver, gold) and serving queries, composed from operators."""
