"""DataFrame operators. Row-local ones (projections, filters, pairs, masks)
use only column expressions (plus one Arrow UDF for difflib), so they also
accept streaming DataFrames; order, batch and metric operators are batch-only."""
