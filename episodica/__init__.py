"""Episode analytics on Spark: episodes, forward matching, labels, history features, audits and marts."""
