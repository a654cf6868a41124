"""How plans are held together: storage between stages, projections, registered queries."""
