"""findloom: scanner-finding normalisation, fingerprinting and clustering as Spark jobs."""
