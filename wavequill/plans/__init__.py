"""Plans: choosing between methods by cost, and the catalogue of registered queries."""
