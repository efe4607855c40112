"""Plan building blocks shared by the operators: lineage cuts, global numbering, overlap joins, sweeps."""
