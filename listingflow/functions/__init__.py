"""Part of listingflow."""
