"""Writers that publish once, with a digest of what they wrote."""
