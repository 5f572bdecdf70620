"""listingflow: Spark jobs for property adverts, leads and text corpora."""
