"""Plan helpers: sessions, lineage cuts, partition sizing, guards."""
