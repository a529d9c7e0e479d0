from propval.sources.tables import read_table, TABLES
from propval.sources.fixtures import listings, scored, fold_predictions

__all__ = ["read_table", "TABLES", "listings", "scored", "fold_predictions"]
