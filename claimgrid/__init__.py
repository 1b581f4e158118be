"""claimgrid: audit report claims against delivered evidence, for a whole corpus, on Spark."""
