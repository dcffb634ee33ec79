"""Quality control, normalization, reduction, clustering and differential expression."""
